"""Secret scans over a ledger of blobs: every text is scanned once for each version of the rules.

Each version of each document is addressed by the SHA-256 of its text. The
ledger holds one row for every (blob, rule version) ever scanned, with the
findings. A scan reads only texts whose pair is not in the ledger, each text
once however many documents hold it, appends what it found, and joins the
findings back to all documents of that text. All of it is column expressions.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedmill.functions.storage import scratch_path, shuffles_removed

LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rule_version", T.StringType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("kind_no", T.IntegerType()),
                        T.StructField("kind", T.StringType()),
                        T.StructField("end", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds are fixed values: results must hold exactly these. Runs of one
# character class match whole or not at all, so their length is in the pattern;
# an assignment that is too short still uses up its text and is dropped after.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----"),
    SecretRule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)
RULE_VERSION = "1"
# For masking, a key goes with its first line: headers, body and END line, however long.
MASK_RULES = (
    *RULES,
    SecretRule(
        "private_key_block",
        r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----\s*(?:Proc-Type:[^\n]*\n)?(?:DEK-Info:[^\n]*\n)?"
        r"[A-Za-z0-9+/=\\\s]*+-----END [A-Z0-9\x20]{0,40}PRIVATE KEY-----",
    ),
)
MASK_VERSION = "1-mask"


def blob_id(text: Column) -> Column:
    """A null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find_spans(texts: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """``blob`` and the sorted ``spans`` of each text of ``texts`` (blob, text).

    ``split`` gives what lies between the matches of a pattern and
    ``regexp_extract_all`` the matches; a match starts after all that came
    before it. That sum runs in a window over the matches of one text and kind,
    so a text with very many matches costs their number, not its square. Window
    and grouping use the partitioning by blob that the texts come in. A text
    without a match is one narrow row.
    """
    kinds = F.array(
        *[
            F.when(
                F.col("text").rlike(rule.pattern),
                F.struct(
                    F.lit(number).alias("kind_no"),
                    F.split("text", rule.pattern).alias("between"),
                    F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("found"),
                ),
            )
            for number, rule in enumerate(rules)
        ]
    )
    hits = texts.select("blob", F.explode_outer(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    pairs = F.transform(
        F.col("k.found"),
        lambda found, i: F.struct(F.length(F.get(F.col("k.between"), i)).alias("gap"), found.alias("found")),
    )
    lists = hits.select("blob", F.col("k.kind_no").alias("kind_no"), pairs.alias("pairs"))
    placed = lists.select("blob", "kind_no", F.posexplode_outer("pairs").alias("place", "m")).select(
        "blob", "kind_no", "place", "m.gap", "m.found", F.length("m.found").alias("size")
    )
    upto = Window.partitionBy("blob", "kind_no").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("long")
    long_enough = F.lit(False)
    for number, rule in enumerate(rules):
        size = F.length(F.regexp_extract("found", rule.pattern, rule.group)) if rule.group else F.col("size")
        long_enough = F.when(F.col("kind_no") == number, size >= rule.least).otherwise(long_enough)
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    span = F.struct(
        (F.col("end") - F.col("size")).alias("start"),
        "kind_no",
        F.get(names, F.col("kind_no")).alias("kind"),
        "end",
    )
    spans = placed.withColumn("end", end).withColumn("span", F.when(long_enough, span))
    return spans.groupBy("blob").agg(
        F.sort_array(F.collect_list("span")).cast(LEDGER["spans"].dataType).alias("spans")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """One row (blob, text) for every text whose pair with this rule version the ledger lacks.

    Copies collapse inside each task before the shuffle, so the hottest text
    travels once from each task.
    """
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.groupBy("blob").agg(F.first("text").alias("text"))


def scan_versions(
    versions: DataFrame,
    ledger_path: str,
    rules: Sequence[SecretRule] = RULES,
    rule_version: str = RULE_VERSION,
) -> None:
    """Scan what the ledger at ``ledger_path`` lacks and append it, findings or none.

    A job that is broken off commits nothing, so the next one scans the same
    pairs again; a second call with nothing new appends nothing.
    """
    spark = versions.sparkSession
    todo = unseen_blobs(versions, read_ledger(spark, ledger_path), rule_version)
    found = find_spans(todo, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    with shuffles_removed(spark):
        found.write.mode("append").parquet(ledger_path)


def findings(
    versions: DataFrame, ledger_path: str, key: Sequence[str], rule_version: str = RULE_VERSION
) -> DataFrame:
    """The ``key`` columns of every row of ``versions`` and the spans of its text."""
    ledger = read_ledger(versions.sparkSession, ledger_path)
    spans = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    rows = versions.select(*key, blob_id(F.col("text")).alias("blob")).join(spans, "blob", "left")
    return rows.select(*key, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def document_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id and the secrets of every document.

    Without a ``ledger_path`` a new ledger is begun in the shared folder. A null
    text has no secret. Rows that share a doc_id each get the findings of their
    own text. Extra columns are not read.
    """
    path = ledger_path or scratch_path(docs.sparkSession, "secret-ledger")
    scan_versions(docs, path)
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))
    return findings(docs, path, ["doc_id"]).select(
        "doc_id",
        *[_count(rule.kind) for rule in BASE_RULES],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redact(docs: DataFrame, mask: str = "[secret]", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` and ``n_chars`` to match.

    A private key is masked up to its END line. Spans that overlap are replaced as one. Texts without secrets, null ones
    included, stay as they are.
    """
    path = ledger_path or scratch_path(docs.sparkSession, "secret-ledger")
    scan_versions(docs, path, MASK_RULES, MASK_VERSION)
    # The text is in the box already and travels once.
    boxed = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    spans = findings(boxed, path, ["doc"], MASK_VERSION).withColumn("text", F.col("doc.text"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > s["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.get(done, F.size(done) - 1)["start"].alias("start"),
                        F.greatest(F.get(done, F.size(done) - 1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    cut = spans.withColumn("merged", merged)
    last = F.element_at("merged", -1)["end"]
    kept = F.transform(
        "merged",
        lambda m, i: F.substr(
            F.col("text"),
            (F.coalesce(F.get(F.col("merged"), i - 1)["end"], F.lit(0)) + 1).cast("int"),
            (m["start"] - F.coalesce(F.get(F.col("merged"), i - 1)["end"], F.lit(0))).cast("int"),
        ),
    )
    clean = F.concat(F.array_join(kept, mask), F.lit(mask), F.substr(F.col("text"), (last + 1).cast("int")))
    clean = F.when(F.size("merged") == 0, F.col("text")).otherwise(clean)
    out = cut.select("doc", clean.alias("clean"), (F.size("merged") > 0).alias("hit"))
    columns = []
    for name in docs.columns:
        value = F.col("doc").getField(name)
        if name == "text":
            value = F.col("clean")
        elif name == "n_chars":
            value = F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(value)
        columns.append(value.alias(name))
    return out.select(*columns)
