"""Queries on samples: splits, shuffles, batches, packing."""

from pyspark.sql import functions as F

from seedmill.functions.columns import words
from seedmill.functions.storage import materialize, scratch_path
from seedmill.operators import splits as sp
from seedmill.plans.registry import query
from seedmill.plans.tables import table, words_sql
from seedmill.sources import sinks

def by(*names):
    return [F.col(name) for name in names]


INDEXED = """WITH indexed AS (
  SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, count(*) OVER () AS n FROM conversations)
"""


def turns(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn")


@query(INDEXED + "SELECT conv_id, turn, CASE WHEN pos < n * 8 // 10 THEN 'train' ELSE 'valid' END AS split FROM indexed")
def split_80_20(spark, folder):
    return sp.split_80_20(turns(spark, folder), by("conv_id", "turn"))


TENTHS = """WITH indexed AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () // 10 AS tenth FROM documents)
"""
SPLIT_70_20 = (
    TENTHS
    + """SELECT doc_id, CASE WHEN pos < tenth * 7 THEN 'train' WHEN pos < tenth * 9 THEN 'valid' ELSE 'test' END AS split
FROM indexed"""
)


@query(SPLIT_70_20)
def split_70_20(spark, folder):
    return sp.split_70_20(table(spark, folder, "documents").select("doc_id"), by("doc_id"))


@query(
    TENTHS
    + """SELECT doc_id, CASE WHEN pos < tenth * 7 THEN 'train' ELSE 'valid' END AS split FROM indexed WHERE pos < tenth * 9
UNION ALL SELECT doc_id, 'test' FROM indexed WHERE pos < tenth * 9"""
)
def split_70_20_compat(spark, folder):
    return sp.split_70_20(table(spark, folder, "documents").select("doc_id"), by("doc_id"), compat=True)


@query(SPLIT_70_20)
def require_nonempty_splits(spark, folder):
    return sp.require_nonempty_splits(split_70_20(spark, folder))


@query(SPLIT_70_20.replace("SELECT doc_id, CASE", "SELECT doc_id::BIGINT AS doc_id, CASE"))
def write_splits(spark, folder):
    path = scratch_path(spark, "splits")
    sinks.write_splits(split_70_20(spark, folder), path)
    return spark.read.schema("doc_id long, split string").json(path)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('17:' || doc_id), doc_id) - 1 AS position FROM documents")
def shuffle(spark, folder):
    return sp.shuffle(table(spark, folder, "documents").select("doc_id"), 17, "doc_id")


@query(
    """SELECT doc_id, pos // 32 AS batch, pos % 32 AS slot FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
WHERE pos // 32 < n // 32"""
)
def batches(spark, folder):
    return sp.batches(table(spark, folder, "documents").select("doc_id"), 32, by("doc_id"))


TOKENS = f"""WITH tokens AS (
  SELECT doc_id, list_transform({words_sql('text')}, lambda w: length(w)) AS tokens,
         (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch, count(*) OVER () // 4 AS batches FROM documents),
longest AS (SELECT batch, max(len(tokens)) AS longest FROM tokens GROUP BY batch)
"""


def token_batches(spark, folder):
    """Batches of four documents; the tokens are word lengths."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    placed = sp.batches(docs.select("doc_id"), 4, by("doc_id"))
    tokens = F.transform(words(F.col("text")), lambda w: F.length(w))
    return docs.join(placed, "doc_id").select("doc_id", "batch", tokens.alias("tokens"))


def _padded(expression: str) -> str:
    return f"md5(array_to_string({expression}, ','))"


@query(
    TOKENS
    + f"""SELECT doc_id, batch, len(tokens) AS length,
  {_padded("list_resize(tokens, longest, 0)[1 : longest - 1]")} AS inputs,
  {_padded("list_resize(tokens, longest, 0)[2 : longest]")} AS targets
FROM tokens JOIN longest USING (batch) WHERE batch < batches"""
)
def pad_batch(spark, folder):
    def shown(column):
        return F.md5(F.array_join(F.col(column).cast("array<string>"), ",")).alias(column)

    return sp.pad_batch(token_batches(spark, folder)).select(
        "doc_id", "batch", F.col("length").cast("long").alias("length"), shown("inputs"), shown("targets")
    )


@query(
    TOKENS
    + """SELECT batch, max(len(tokens)) AS longest, count(*) FILTER (WHERE len(tokens) > 2048) AS long_rows,
  max(len(tokens)) > 2048 AS warn FROM tokens WHERE batch < batches GROUP BY batch"""
)
def warn_long(spark, folder):
    length = F.size("tokens").cast("long")
    return sp.warn_long(token_batches(spark, folder), length)


LENGTHS = f"WITH lengths AS (SELECT doc_id, len({words_sql('text')}) AS n_words FROM documents)\n"


def lengths(spark, folder):
    return table(spark, folder, "documents").select("doc_id", sp.token_length(F.col("text")).cast("long").alias("n_words"))


@query(LENGTHS + "SELECT doc_id, n_words FROM lengths WHERE n_words <= 4096")
def drop_long(spark, folder):
    return sp.drop_long(lengths(spark, folder), F.col("n_words"))


PACKED = (
    LENGTHS
    + """, fitted AS (
  SELECT doc_id, n_words, 32768 // greatest(n_words, 1) AS fit FROM lengths),
packed AS (
  SELECT *, (row_number() OVER (PARTITION BY fit ORDER BY n_words DESC, doc_id) - 1) // fit AS pack FROM fitted)
"""
)


def packed(spark, folder):
    """Packing reads the lengths several times, so the texts are counted once and the lengths stored."""
    return sp.pack_sequences(materialize(lengths(spark, folder), "lengths"), "n_words", 32_768, by("doc_id"))


@query(PACKED + "SELECT doc_id, n_words, fit, pack FROM packed")
def pack_sequences(spark, folder):
    return packed(spark, folder)


@query(
    PACKED
    + """SELECT sum(tokens) / sum(samples) AS avg_sample_len, count(*) AS num_batches,
  sum(samples) / count(*) AS avg_samples_per_batch, max(tokens)::BIGINT AS longest_batch
FROM (SELECT count(*) AS samples, sum(n_words) AS tokens FROM packed GROUP BY fit, pack)"""
)
def packing_stats(spark, folder):
    return sp.packing_stats(packed(spark, folder), "n_words")


@query(
    PACKED
    + """SELECT count(*) AS samples, sum(greatest(n_words, 1))::BIGINT AS tokens, true AS none_over_the_limit,
  true AS packs_are_97_percent_full, true AS packs_are_numbered_without_gaps FROM packed"""
)
def pack_by_patterns(spark, folder):
    """Packs of 8,192 words of all documents, whose long texts are cut at the limit first."""
    whole = lengths(spark, folder).select("doc_id", F.greatest("n_words", F.lit(1)).alias("n_words"))
    pieces = whole.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(8192))).alias("piece", "at"), "n_words")
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(8192), F.col("n_words") - F.col("at")).alias("n_words"))
    placed = sp.pack_by_patterns(materialize(pieces, "pieces"), "n_words", 8192, by("doc_id", "piece"))
    packs = placed.groupBy("pack").agg(F.sum("n_words").alias("tokens"), F.count_if(F.col("piece") == 0).alias("samples"))
    return packs.agg(
        F.sum("samples").alias("samples"),
        F.sum("tokens").alias("tokens"),
        (F.max("tokens") <= 8192).alias("none_over_the_limit"),
        (F.sum("tokens") >= 0.97 * 8192 * F.count(F.lit(1))).alias("packs_are_97_percent_full"),
        (F.max("pack") + 1 == F.count(F.lit(1))).alias("packs_are_numbered_without_gaps"),
    )
