"""Weighted rendezvous hashing: each record goes to the shard that scores best for its key.

A shard's score for a key is ``-ln(u) / weight`` with ``u`` uniform in (0, 1),
taken from a digest of the key and the shard's number; the least score wins.
A score depends on nothing but the key, that number and that weight, so a new
shard takes records only into itself, a removed one gives away only its own,
and a changed weight moves records only to or from that shard.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize

LANES = 4  # one digest of 128 bits serves four shards with 32 bits each
BUCKET_DIGITS = 3  # slots are counted in 16 ** 3 buckets a shard: a bound, not a function of the data
COPIES_PER_RUN = 65_536


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, shard), one for each shard. A null key counts as the empty key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError(f"shard {shard} has weight {weight}; weights are above zero")
        digest = F.md5(F.concat(text, F.lit(f"#{shard // LANES}")))
        lane = F.conv(F.substring(digest, 1 + 8 * (shard % LANES), 8), 16, 10).cast("double")
        score = -F.ln((lane + 0.5) / float(2**32)) / float(weight)
        scores.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return F.array(*scores)


def best_shard(scores: Column) -> Column:
    """The shard with the least score; of equal scores, the smaller shard."""
    return F.array_min(scores)["shard"]


def assign_shards(
    records: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None
) -> DataFrame:
    """All columns of ``records`` and a struct ``placed`` of shard and grown_shard.

    ``grown_shard`` is the record's shard after one more shard of ``grown_weight``
    has come (null without it). One pass, no shuffle. Records that share a key
    share a shard. An empty table gives an empty one.
    """
    now = shard_scores(F.col(key), weights)
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        grown = best_shard(shard_scores(F.col(key), [*weights, grown_weight]))
    return records.withColumn("placed", F.struct(best_shard(now).alias("shard"), grown.alias("grown_shard")))


def with_slots(placed: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Add each record's place in its shard, gapless from 0.

    The order is that of a digest of all columns, so it needs no ids and equal
    rows, which no one can tell apart, follow each other. They are counted
    before the shuffle: a row that makes up a third of the table is one row
    with a count. Places are counted in digest buckets of each shard, whose
    starts come from one small table (shards times 4,096 rows), so no task has
    to see a whole shard.
    """
    columns = placed.columns
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    counted = placed.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    counted = materialize(counted.withColumn("_digest", digest), "slots")
    bucket = F.substring("_digest", 1, BUCKET_DIGITS)
    keyed = counted.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(shard, "_bucket")
        .agg(F.sum("_copies").alias("_rows"))
        .select(shard, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy("_digest", *columns)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    run, runs = F.lit(COPIES_PER_RUN), F.floor((F.col("_copies") - 1) / COPIES_PER_RUN)
    ends = F.least((F.col("_run") + 1) * run, F.col("_copies")) - 1
    return (
        keyed.withColumn("_inside", first)
        .join(F.broadcast(starts), [shard, "_bucket"])
        .withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), runs)))
        .withColumn("_copy", F.explode(F.sequence(F.col("_run") * run, ends)))
        .select(*columns, (F.col("_start") + F.col("_inside") + F.col("_copy")).cast("long").alias(slot))
    )


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown_weight: float, overhead: int = 16
) -> DataFrame:
    """Shard, size, checksum and slot of every document, by its doc_id.

    A null text has no bytes. Repeated rows each get a slot of their own; extra
    columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(known, "doc_id", weights, grown_weight).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "placed.*"
    )
    return with_slots(placed, "shard")
