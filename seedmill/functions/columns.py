"""Column-to-column functions, all evaluated inside the JVM unless said otherwise."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedmill import fixed

_UNICODE = "(?U)"  # letters and digits of all scripts in the name patterns


def exploded(df: DataFrame, keep: list, array: Column, position: str, name: str) -> DataFrame:
    """One row per array element, none for an empty array.

    The outer form with a filter behind it: for the plain form Spark adds a
    "size > 0" filter in front, which works out the whole array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(position).isNotNull())


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(fixed.WHITESPACE))


def words(text: Column) -> Column:
    """Items between blanks; an empty or blank text has none."""
    return F.array_remove(F.split(strip(text), fixed.BLANKS_PATTERN), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def char_count(text: Column) -> Column:
    return F.length(text)


def human_size(size: Column, places: int = 2) -> Column:
    """1024-based size text, capped at GB."""
    value = size.cast("double")
    kilo = 1024.0

    def scaled(power: int, unit: str) -> Column:
        return F.concat(fixed_text(value / F.lit(kilo**power), places), F.lit(f" {unit}"))

    return (
        F.when(value < kilo, scaled(0, "B"))
        .when(value < kilo**2, scaled(1, "KB"))
        .when(value < kilo**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def model_name_from_file(name: Column) -> Column:
    found = F.regexp_extract(name, _UNICODE + fixed.DATASET_NAME_PATTERN, 2)
    return F.when(found == "", F.lit("General")).otherwise(found)


def run_id_from_path(relative: Column) -> Column:
    return F.element_at(F.split(relative, "/"), 1)


def base_name(path: Column) -> Column:
    """Last part of a path; trailing slashes do not count."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def folder_name(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def elapsed_seconds(start: Column, end: Column | None = None) -> Column:
    """Whole seconds between two timestamps; an open end means now."""
    until = F.current_timestamp() if end is None else F.coalesce(end, F.current_timestamp())
    return F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def runtime_text(seconds: Column) -> Column:
    """``[Nd ]HH:MM:SS``."""
    days = F.floor(seconds / 86400)
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600) % 24,
        F.floor(seconds / 60) % 60,
        seconds % 60,
    )
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), clock)).otherwise(clock)


def whole_days(start: Column, now: Column) -> Column:
    return F.floor(
        (F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp")))
        / F.lit(86_400_000_000)
    )


def is_completed(status: Column) -> Column:
    return status.isin(fixed.DONE, fixed.ERRORED)


def is_s3_bucket(location: Column) -> Column:
    return location.rlike(fixed.S3_BUCKET_PATTERN)


def is_oci_url(location: Column) -> Column:
    return location.startswith("docker://") & location.rlike(fixed.OCI_URL_PATTERN)


def is_owner_model(location: Column) -> Column:
    return location.rlike(_UNICODE + fixed.OWNER_MODEL_PATTERN)


def classify_repo(location: Column) -> Column:
    return (
        F.when(is_oci_url(location), "oci")
        .when(is_owner_model(location), "owner/model")
        .when(is_s3_bucket(location), "s3")
        .otherwise("unknown")
    )


def listing_time(moment: Column) -> Column:
    return F.date_format(moment, fixed.LISTING_TIME)


def run_folder_time(moment: Column) -> Column:
    return F.date_format(moment, fixed.RUN_FOLDER_TIME)


def fixed_text(value: Column, places: int) -> Column:
    """A number with a fixed count of decimals, rounded on its exact binary value, halves to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def round2(value: Column) -> Column:
    """Two places, decided on the exact binary value: 0.125 gives 0.12 and 2.675 gives 2.67."""
    return fixed_text(value, 2).cast("double")


def is_seed_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1).isin(*fixed.TAXONOMY_FOLDERS) & (
        base_name(path) == fixed.SEED_FILE_NAME
    )


def seed_name_warning(path: Column) -> Column:
    """True where a file in a taxonomy folder nearly has the right name and is left out."""
    return (
        F.element_at(F.split(path, "/"), 1).isin(*fixed.TAXONOMY_FOLDERS)
        & (base_name(path) != fixed.SEED_FILE_NAME)
        & F.lower(base_name(path)).isin(*fixed.SEED_FILE_NEAR_NAMES)
    )


def glob_to_regex(pattern: Column) -> Column:
    """A shell pattern as an anchored regular expression.

    ``*`` and ``?`` stop at a slash, and a leading wildcard skips hidden names.
    """
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    negated = F.regexp_replace(escaped, r"\[!", "[^")
    starred = F.regexp_replace(negated, r"\*+", "[^/]*")
    single = F.regexp_replace(starred, r"\?", "[^/]")
    visible = F.regexp_replace(single, r"(^|/)\[", r"$1(?!\\.)[")
    return F.concat(F.lit("^"), visible, F.lit("$"))
