"""Exact positions and running sums over data too large for one sorted task.

Spark has no global row index. A window without partitions pulls all rows into
one task, and a window over a key does the same to the hottest key. Here the rows
are dealt out by ranges of the sort key, keys first and then the order, and
stored with the number of their range. Every range is ranked on its own. Its last
key may go on in the next range, so what came before a range's first key is a sum
over one row for each range, joined back by the range's number. Nothing of the
data is in the plan, which is the same for ten rows and for ten billion.

Ranges only balance the work: every row is kept and positions are exact. The
order columns must identify a row, as they do for any stable sort.
"""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedmill.functions.sizing import task_slots
from seedmill.functions.storage import materialize

ROWS_PER_BUCKET = 1_000_000


def _literal(row, schema: T.StructType) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields])


def _before(stored: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(range, first key, amounts): how much of a range's first key lies in earlier ranges.

    One row a range and key is counted where the rows are; of those only the last
    key of each range counts on, and the running sums over the ranges that end with
    one key are over a row for each range.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    amounts = [F.count(F.lit(1)).alias("_n0"), *[F.sum(s).alias(f"_n{k}") for k, s in enumerate(sums, 1)]]
    names = [f"_n{k}" for k in range(len(sums) + 1)]
    by_key = stored.groupBy("_range", key.alias("_key")).agg(*amounts)
    ranges = by_key.groupBy("_range").agg(
        F.min("_key").alias("_first"), F.max("_key").alias("_last"), F.max_by(F.struct(*names), "_key").alias("_tail")
    )
    ended = Window.partitionBy("_last").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    so_far = ranges.select(
        "_range", "_first", "_last", *[F.sum(F.col("_tail")[n]).over(ended).alias(n) for n in names]
    )
    follows = Window.orderBy("_range")
    goes_on = F.lag("_last").over(follows) == F.col("_first")
    return so_far.select(
        F.col("_range"), F.col("_first"), *[F.when(goes_on, F.lag(n).over(follows)).alias(n) for n in names]
    )


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    running: Mapping[str, Column] | None = None,
    position: str = "position",
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 0-based ``position`` of each row, overall or within ``keys``.

    ``running`` maps new column names to numeric expressions; each gets the sum
    from the first row of its group up to and including the row. ``order`` is
    ascending; negate a number to reverse it. A column of ``df`` that is named like
    a new one is an error.
    """
    running = dict(running or {})
    clashes = sorted({position, *running} & set(df.columns))
    if clashes:
        raise ValueError(f"the table has columns {clashes} already")
    rows = df.count() if rows is None else rows
    key_names = [f"_k{i}" for i in range(len(keys))]
    order_names = [f"_o{i}" for i in range(len(order))]
    sum_names = [f"_s{i}" for i in range(len(running))]
    staged = df.select(
        F.struct("*").alias("_row"),
        *[F.col(k).alias(n) for k, n in zip(keys, key_names, strict=True)],
        *[c.alias(n) for c, n in zip(order, order_names, strict=True)],
        *[c.alias(n) for c, n in zip(running.values(), sum_names, strict=True)],
    )
    ranges = max(task_slots(df.sparkSession), math.ceil(rows / rows_per_bucket))
    dealt = staged.repartitionByRange(ranges, *key_names, *order_names).withColumn("_range", F.spark_partition_id())
    stored = materialize(dealt, "ranges")
    before = _before(stored, key_names, sum_names)

    key = F.struct(*key_names) if key_names else F.struct(F.lit(0).alias("all"))
    starts = key.eqNullSafe(F.col("_first"))
    window = Window.partitionBy("_range", *key_names).orderBy(*order_names)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def earlier(number: int) -> Column:
        return F.coalesce(F.when(starts, F.col(f"_n{number}")), F.lit(0))

    place = (F.row_number().over(window) - 1).cast("long") + earlier(0).cast("long")
    sums = [
        (F.coalesce(F.sum(s).over(upto), F.lit(0)) + earlier(k)).alias(name)
        for k, (name, s) in enumerate(zip(running, sum_names, strict=True), 1)
    ]
    ranked = stored.join(before, "_range").select("_row", place.alias(position), *sums)
    return ranked.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], position, *running)


def cut_at(
    df: DataFrame,
    order: Sequence[Column],
    positions: Sequence[int],
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> list[Column]:
    """For each position, the condition "this row comes before that position".

    Only the order columns are ranked; the one row at each position comes back
    as a literal, so labelling the wide rows needs no shuffle.
    """
    rows = df.count() if rows is None else rows
    names = [f"o{i}" for i in range(len(order))]
    keys_only = df.select(*[c.alias(n) for c, n in zip(order, names, strict=True)])
    wanted = sorted({p for p in positions if 0 <= p < rows})
    found = {}
    if wanted:
        ranked = with_position(
            keys_only,
            [F.col(n) for n in names],
            rows=rows,
            rows_per_bucket=rows_per_bucket,
        )
        found = {r["position"]: r for r in ranked.filter(F.col("position").isin(wanted)).collect()}
    here = F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)])
    conditions = []
    for p in positions:
        if p >= rows:
            conditions.append(F.lit(True))
        elif p <= 0:
            conditions.append(F.lit(False))
        else:
            conditions.append(here < _literal(found[p], keys_only.schema))
    return conditions
