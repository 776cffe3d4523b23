"""Resolve not-modified revisits of a web archive to the full response they stand for.

A revisit record says that a server answered "not modified": it has headers but
no body. The body is that of the latest earlier full response for the same
canonical URL, provided that the validators (ETag, else Last-Modified) agree.
The headers of the resolved record are those of the response, updated with the
ones that a not-modified answer may update.

The as-of join has no range condition and no pair is built: responses and
revisits are sorted together and each revisit takes the last response before
it. So that one URL with a third of all records is no single task, time is cut
at quantiles of all records; a URL's records of one time slice form a group,
and the last response of the earlier slices goes into each slice as its first
row.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize

TIME_SLICES = 256
# The header fields that a not-modified answer carries for the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that follow the visitor and not the page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid|sid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a last slash do not tell pages apart."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^(?i)https?://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    parts = F.split(F.regexp_extract(bare, r"(?s)\?(.*)$", 1), "&")
    parts = F.filter(parts, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.sort_array(parts), "&")
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def plain_headers(headers: Column) -> Column:
    """Header names in lower case; fields of one name joined with a comma. Null is no header."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    values = F.transform(
        names,
        lambda n: F.array_join(
            F.transform(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), lambda e: F.trim(e["value"])), ", "
        ),
    )
    return F.map_from_arrays(names, values)


def validators_agree(stored: Column, fresh: Column) -> Column:
    """True or false by ETag, else by Last-Modified; null when they share neither. Weak tags compare as strong ones."""

    def tag(headers: Column) -> Column:
        return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r"^W/", "")

    by_date = F.try_element_at(stored, F.lit("last-modified")) == F.try_element_at(fresh, F.lit("last-modified"))
    return F.coalesce(tag(stored) == tag(fresh), by_date)


def merge_headers(stored: Column, fresh: Column, permitted: Sequence[str] = PERMITTED) -> Column:
    """The stored headers, with the permitted ones of the fresh answer in their place."""
    allowed = F.map_filter(fresh, lambda name, _: name.isin(*permitted))
    kept = F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.map_concat(kept, allowed)


def _slices(records: DataFrame, slices: int) -> Column:
    """The number of the time slice of a record."""
    steps = [i / slices for i in range(1, slices)]
    cuts = records.agg(F.percentile_approx("ts", steps, 10_000).alias("cuts")).first()["cuts"]
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return F.size(F.filter(bounds, lambda cut: cut <= F.col("ts")))


def resolve_revisits(records: DataFrame, time_slices: int = TIME_SLICES) -> DataFrame:
    """One row for each revisit record of ``records``.

    ``records``: record_id long, url string, ts long (any unit), full boolean
    (true: full response, false: not-modified revisit), headers map, digest
    string (of the payload). A record whose ``full`` is null takes no part.

    Returns record_id, url, canonical_url, ts, outcome, refers_to, digest and
    headers. Outcomes: ``resolved`` (validators agree; digest of the response,
    merged headers), ``mismatch`` and ``unverified`` (they differ, or share
    none: refers_to names the response, digest is null and the headers stay the
    revisit's own), ``no_response`` (none is earlier, or url or ts is null).

    Earlier means a smaller ts. Of full responses with one ts the one with the
    largest record_id counts, then the largest digest. Repeated rows are
    resolved each. Extra columns are not read.
    """
    plain = records.select(
        "record_id",
        "url",
        canonical_url(F.col("url")).alias("canonical_url"),
        "ts",
        F.col("full").cast("boolean").alias("full"),
        plain_headers(F.col("headers")).alias("own"),
        F.when(F.col("full"), F.col("digest")).alias("own_digest"),
    ).filter("full IS NOT NULL AND (NOT full OR (canonical_url IS NOT NULL AND ts IS NOT NULL))")
    plain = materialize(plain, "captures")
    nowhere = "canonical_url IS NULL OR ts IS NULL"
    timed = plain.filter(f"NOT ({nowhere})")
    timed = timed.withColumn("slice", _slices(timed, time_slices))
    stored = F.when(
        F.col("full"), F.struct("ts", "record_id", F.col("own_digest").alias("digest"), F.map_entries("own").alias("entries"))
    )

    per_slice = timed.withColumn("stored", stored).groupBy("canonical_url", "slice").agg(
        F.max("stored").alias("last"),
        F.count_if(~F.col("full")).alias("revisits"),
    )
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_slice.withColumn("stored", F.last("last", ignorenulls=True).over(before))
        .filter("stored IS NOT NULL AND revisits > 0")
        .select("canonical_url", "slice", "stored", F.lit(0).alias("turn"))
    )
    # At one ts a revisit comes before the responses, so that it sees only earlier ones.
    rows = timed.withColumn("stored", stored).withColumn("turn", F.when(F.col("full"), 2).otherwise(1))
    both = rows.unionByName(carried, allowMissingColumns=True)
    order = [F.col("turn") > 0, F.col("ts"), F.col("turn"), F.col("record_id"), F.col("own_digest")]
    upto = Window.partitionBy("canonical_url", "slice").orderBy(*order)
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("match", F.last("stored", ignorenulls=True).over(upto)).filter("turn = 1")
    columns = ["record_id", "url", "canonical_url", "ts", "own"]
    lost = plain.filter(nowhere).select(*columns)
    return _resolved(matched.select(*columns, "match").unionByName(lost, allowMissingColumns=True))


def _resolved(matched: DataFrame) -> DataFrame:
    stored = F.map_from_entries("match.entries")
    agree = validators_agree(stored, F.col("own"))
    outcome = (
        F.when(F.col("match").isNull(), "no_response")
        .when(agree.isNull(), "unverified")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    resolved = F.col("outcome") == "resolved"
    return matched.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "canonical_url",
        "ts",
        "outcome",
        F.col("match.record_id").alias("refers_to"),
        F.when(resolved, F.col("match.digest")).alias("digest"),
        F.when(resolved, merge_headers(stored, F.col("own"))).otherwise(F.col("own")).alias("headers"),
    )
