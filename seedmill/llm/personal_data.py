"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Every kind is a pattern, a check of what it found, a score to begin with, and
words that speak for or against it when they stand near. The base kinds keep
every span that passes its check, whatever the score; further kinds keep those
that reach a threshold. All of it is column expressions. Only numbers are
shuffled: checks and scores are made where the text is read.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR = 40
FOR, AGAINST = 30, 40
THRESHOLD = 60

# Lengths of account numbers by country.
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a Luhn checksum of zero: every second digit from the right counts double."""
    doubled = F.translate(number, "0123456789", "0246813579")

    def summed(text: Column, parity: int) -> Column:
        ones = F.regexp_extract_all(F.reverse(text), F.lit("[0-9]"), F.lit(0))
        own = F.filter(ones, lambda _, i: i % 2 == parity)
        return F.aggregate(own, F.lit(0), lambda total, digit: total + digit.cast("int"))

    return (summed(number, 0) + summed(doubled, 1)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters last and letters as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    characters = F.regexp_extract_all(moved, F.lit("[A-Z0-9]"), F.lit(0))

    def step(rest: Column, character: Column) -> Column:
        letter = (rest * 100 + F.ascii(character) - 55) % 97
        return F.when(character.rlike("[A-Z]"), letter).otherwise((rest * 10 + F.ascii(character) - 48) % 97)

    return F.aggregate(characters, F.lit(0), step) == 1


def _whole(m: Column) -> Column:
    return F.length(m["found"])


def _iban_chars(m: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in IBAN_CHARS.items() for x in pair])
    return F.try_element_at(known, F.substring(m["found"], 1, 2))


def _iban_size(m: Column) -> Column:
    """Characters of the span: as many as the country has, with the blanks between groups of four."""
    chars = _iban_chars(m)
    spaced = F.substring(m["found"], 5, 1) == " "
    return F.when(spaced, chars + F.floor((chars - 1) / 4).cast("int")).otherwise(chars)


def _is_email(m: Column) -> Column:
    return F.lit(True)


def _is_address(m: Column) -> Column:
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return m["found"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _is_card(m: Column) -> Column:
    number = digits(m["found"])
    return F.when(F.length(m["found"]) > 37, F.lit(False)).otherwise(
        F.length(number).between(12, 19) & luhn(number)
    )


def _is_phone(m: Column) -> Column:
    return F.length(digits(m["found"])).between(9, 15)


def _is_iban(m: Column) -> Column:
    span = F.substr(m["found"], F.lit(1), _iban_size(m))
    account = F.replace(span, F.lit(" "), F.lit(""))
    following = F.concat(F.substr(m["found"], _iban_size(m) + 1), m["after"])
    apart = ~m["before"].rlike("[A-Za-z0-9]$") & ~following.rlike("^[A-Za-z0-9]")
    return F.coalesce(apart & (F.length(account) == _iban_chars(m)) & mod97(account), F.lit(False))


def _is_ssn(m: Column) -> Column:
    apart = ~m["before"].rlike("[0-9A-Za-z-]$") & ~m["after"].rlike("^[0-9A-Za-z-]")
    return apart & ~m["found"].rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class PiiKind:
    """What a kind of span looks like.

    ``pattern`` says which spans there are; ``quick`` finds the same ones without
    trying a long run again from each of its characters. ``size`` is the span's
    length where that is not the whole match.
    """

    kind: str
    pattern: str
    quick: str
    check: Callable[[Column], Column]
    score: int
    near: str
    against: str = "example|sample|dummy|version|isbn"
    size: Callable[[Column], Column] = _whole


# The patterns of the base kinds; results must hold exactly these.
BASE_KINDS = (
    PiiKind(
        "email",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _is_email, 70, "mail|contact|write|reach",
    ),
    PiiKind(
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _is_address, 50, "ip|address|host|server|login|client",
    ),
    PiiKind(
        "card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++",
        _is_card, 60, "card|visa|credit|payment|paid|debit",
    ),
    PiiKind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
        _is_phone, 60, "phone|call|tel|mobile|fax",
    ),
)
MORE_KINDS = (
    PiiKind(
        "iban",
        r"[A-Z]{2}[0-9]{2}((\x20[A-Z0-9]{4})+(\x20[A-Z0-9]{1,3})?|[A-Z0-9]+)",
        r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4})++(?:\x20[A-Z0-9]{1,3})?+|[A-Z0-9]++)",
        _is_iban, 80, "iban|account|bank|transfer", size=_iban_size,
    ),
    PiiKind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        _is_ssn, 40, "ssn|social security|insurance|taxpayer",
    ),
)
KINDS = (*BASE_KINDS, *MORE_KINDS)


def near_words(words: str) -> str:
    """A pattern for whole words, in lower case, of which one may end the context or begin it."""
    return rf"(^|[^a-z])({words})([^a-z]|$)"


def score(kind: PiiKind, m: Column) -> Column:
    """0 to 100: the kind's own score, more with a word for it nearby and less with one against it."""
    context = F.lower(F.concat_ws(" ", m["before"], m["after"]))
    moved = F.lit(kind.score)
    moved = moved + F.when(context.rlike(near_words(kind.near)), FOR).otherwise(0)
    moved = moved - F.when(context.rlike(near_words(kind.against)), AGAINST).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), moved))


def propose(texts: DataFrame, kinds: Sequence[PiiKind]) -> DataFrame:
    """``row``, ``doc_id`` and, for every match, its place among those of its kind, its sizes, check and score.

    ``split`` gives what lies between the matches, so the context of a match is
    the end of the part before it and the beginning of the part after it: up to
    ``NEAR`` characters on each side, never across another match of the kind. A
    text without a match is one row without a kind.
    """
    hits = F.array(
        *[
            F.when(
                F.col("text").rlike(kind.quick),
                F.struct(
                    F.lit(number).alias("kind_no"),
                    F.split("text", kind.quick).alias("between"),
                    F.regexp_extract_all("text", F.lit(kind.quick), F.lit(0)).alias("found"),
                ),
            )
            for number, kind in enumerate(kinds)
        ]
    )
    by_kind = texts.select("row", "doc_id", F.explode_outer(F.filter(hits, lambda h: h.isNotNull())).alias("h"))

    def match(found: Column, place: Column) -> Column:
        gap = F.get(F.col("h.between"), place)
        return F.struct(
            place.alias("place"),
            F.length(gap).alias("gap"),
            F.right(gap, F.lit(NEAR)).alias("before"),
            found.alias("found"),
            F.left(F.get(F.col("h.between"), place + 1), F.lit(NEAR)).alias("after"),
        )

    lists = by_kind.select("row", "doc_id", F.col("h.kind_no").alias("kind_no"), F.transform("h.found", match).alias("all"))
    matches = lists.select("row", "doc_id", "kind_no", F.explode_outer("all").alias("m"))
    m = F.col("m")
    good, points, size = F.lit(False), F.lit(0), F.lit(0)
    for number, kind in enumerate(kinds):
        here = F.col("kind_no") == number
        enough = kind.check(m) if kind in BASE_KINDS else kind.check(m) & (score(kind, m) >= THRESHOLD)
        good = F.when(here, enough).otherwise(good)
        points = F.when(here, score(kind, m)).otherwise(points)
        size = F.when(here, kind.size(m)).otherwise(size)
    return matches.select(
        "row",
        "doc_id",
        "kind_no",
        "m.place",
        (F.col("m.gap") + F.length("m.found")).alias("step"),
        F.length("m.found").alias("found_chars"),
        size.alias("size"),
        good.alias("good"),
        points.alias("score"),
    )


def personal_data(docs: DataFrame, kinds: Sequence[PiiKind] = KINDS) -> DataFrame:
    """doc_id and ``spans`` (start, kind_no, kind, end, score) of every document, by start and then kind.

    Starts and ends count characters. Spans of different kinds may overlap. A
    null text has no span, an empty table gives an empty one, rows that share a
    doc_id each get the spans of their own text, and other columns are not read.
    Where a match begins is a running sum over the matches of one kind in one
    text, so a long text with very many matches costs their number and not its
    square.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    placed = propose(texts, kinds).repartition("row")
    upto = Window.partitionBy("row", "kind_no").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("start", F.sum("step").over(upto).cast("long") - F.col("found_chars"))
    names = F.array(*[F.lit(kind.kind) for kind in kinds])
    span = F.struct(
        "start",
        "kind_no",
        F.get(names, F.col("kind_no")).alias("kind"),
        (F.col("start") + F.col("size")).alias("end"),
        "score",
    )
    kept = ends.withColumn("span", F.when(F.col("good"), span))
    return kept.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans")).drop("row")


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def document_personal_data(docs: DataFrame) -> DataFrame:
    """The numbers of base spans of each document, a hash of them, and all spans as text."""

    def count(kind: PiiKind) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind.kind)).cast("long").alias(f"n_{kind.kind}")

    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    return personal_data(docs).select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
