"""Splits by position, seeded shuffles, batches, padding and packing.

File order means nothing to Spark, so every positional operator takes ``order``:
columns that identify a row. Nothing here sorts all rows in one task.
"""

from bisect import bisect_right
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.columns import word_count
from seedmill.functions.ordering import cut_at, with_position


def split_80_20(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First ``n*8//10`` rows train, the rest valid. The wide rows are labelled where they are."""
    rows = df.count()
    (train,) = cut_at(df, order, [rows * 8 // 10], rows)
    return df.withColumn("split", F.when(train, "train").otherwise("valid"))


def split_70_20(
    df: DataFrame,
    order: Sequence[Column],
    compat: bool = False,
) -> DataFrame:
    """Tenths of the row count: seven train, two valid, the remaining rows test.

    ``compat`` writes the older test split, which repeats train and valid.
    """
    rows = df.count()
    n = rows // 10 * 7
    m = n + rows // 10 * 2
    train, valid = cut_at(df, order, [n, m], rows)
    if not compat:
        return df.withColumn(
            "split", F.when(train, "train").when(valid, "valid").otherwise("test")
        )
    sides = F.when(train, F.array(F.lit("train"), F.lit("test"))).when(
        valid, F.array(F.lit("valid"), F.lit("test"))
    )
    return df.withColumn("split", F.explode(sides))


def require_nonempty_splits(df: DataFrame, names: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Raise for a split without rows. Only the split names present travel."""
    present = {row["split"] for row in df.select("split").distinct().collect()}
    labels = {"train": "Training", "valid": "Validation", "test": "Test"}
    for name in names:
        if name not in present:
            raise ValueError(f"the {name} split has no rows")
    return df


def shuffle_key(seed: int, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


def shuffle(
    df: DataFrame, seed: int, row_id: str
) -> DataFrame:
    """A permutation that the seed fixes, as a 0-based ``position``."""
    return with_position(
        df, [shuffle_key(seed, F.col(row_id)), F.col(row_id)]
    )


def batches(
    df: DataFrame,
    size: int,
    order: Sequence[Column],
) -> DataFrame:
    """Consecutive batches of exactly ``size`` rows; an incomplete last batch is not formed."""
    rows = df.count()
    placed = with_position(df, order, rows=rows)
    return (
        placed.withColumn("batch", F.floor(F.col("position") / size))
        .withColumn("slot", F.col("position") % size)
        .filter(F.col("batch") < rows // size)
        .drop("position")
    )


def pad_batch(df: DataFrame, tokens: str = "tokens", pad: int = 0) -> DataFrame:
    """Token arrays padded to the longest of their batch, as inputs and targets shifted by one.

    A batch has a fixed small number of rows, so its window is one too.
    """
    array = F.col(tokens)
    longest = F.max(F.size(array)).over(Window.partitionBy("batch"))
    padded = F.concat(
        array, F.array_repeat(F.lit(pad).cast("int"), F.col("_longest") - F.size(array))
    )
    return df.withColumn("_longest", longest).select(
        *df.columns,
        F.size(array).alias("length"),
        F.slice(padded, 1, F.col("_longest") - 1).alias("inputs"),
        F.slice(padded, 2, F.col("_longest") - 1).alias("targets"),
    )


def token_length(text: Column) -> Column:
    """Default token count: words."""
    return word_count(text)


def drop_long(df: DataFrame, length: Column, max_len: int = fixed.MAX_SEQUENCE_TOKENS) -> DataFrame:
    return df.filter(length <= max_len)


def warn_long(df: DataFrame, length: Column, limit: int = fixed.WARN_SEQUENCE_TOKENS) -> DataFrame:
    """Per batch, whether it holds a sequence over the limit; nothing is dropped."""
    return df.groupBy("batch").agg(
        F.max(length).alias("longest"),
        F.count_if(length > limit).alias("long_rows"),
        (F.max(length) > limit).alias("warn"),
    )


def pack_sequences(
    df: DataFrame,
    length: str,
    max_batch_len: int,
    order: Sequence[Column],
) -> DataFrame:
    """Assign samples to packs of at most ``max_batch_len`` tokens.

    Samples are grouped by how many of them surely fit: with ``fit =
    max_batch_len // length``, any ``fit`` samples of a group make a legal
    pack, filled to at least ``fit / (fit + 1)``. A pack is then just a
    position divided by ``fit``; no task has to walk over the samples one by one.
    A sample over the limit is an error: drop long samples first.
    """
    too_long = F.raise_error(F.lit("a sample is longer than the pack")).cast("long")
    fit = F.when(F.col(length) > max_batch_len, too_long).otherwise(
        F.floor(F.lit(max_batch_len) / F.greatest(F.col(length), F.lit(1)))
    )
    placed = with_position(
        df.withColumn("fit", fit),
        [-F.col(length), *order],
        keys=["fit"],
    )
    return placed.withColumn("pack", F.floor(F.col("position") / F.col("fit"))).drop("position")


def pack_patterns(histogram: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many samples of which length share a pack) and how often each is used.

    Best fit with the longest first, done for all packs that come out alike at
    once: a pattern starts with the longest length left, takes the longest that
    still fits while there is one, and is used until one of its lengths runs out.
    """
    left = {length: count for length, count in histogram.items() if count}
    lengths = sorted(left)
    found = []
    while lengths:
        room, pattern, end = capacity, {}, len(lengths)
        while room > 0:
            end = bisect_right(lengths, room, 0, end)
            if not end:
                break
            length = lengths[end - 1]
            taken = min(room // length, left[length])
            pattern[length] = taken
            room -= taken * length
            end -= 1
        uses = min(left[length] // taken for length, taken in pattern.items())
        found.append((pattern, uses))
        for length, taken in pattern.items():
            left[length] -= taken * uses
            if not left[length]:
                del lengths[bisect_right(lengths, length) - 1]
    return found


def pack_by_patterns(
    df: DataFrame,
    length: str,
    max_batch_len: int,
    order: Sequence[Column],
) -> DataFrame:
    """Assign samples to packs of at most ``max_batch_len`` tokens, as full as patterns of lengths make them.

    Only the histogram of lengths comes to the driver, at most one row for each
    length up to the limit, whatever the number of samples. It is cut into patterns
    there. A sample then finds its pack by its place among those of its length: the
    places of a length are dealt to patterns in stretches, and within a stretch every
    so many make a pack. Adds ``pack``, gapless from 0. A sample of no length counts
    as one token; one over the limit is an error, a null length too; an empty table
    gives an empty one.
    """
    size = F.greatest(F.col(length), F.lit(1)).cast("long")
    wrong = F.raise_error(F.lit("a sample is longer than the pack, or of unknown length")).cast("long")
    sized = df.withColumn("_size", F.when(F.col(length) <= max_batch_len, size).otherwise(wrong))
    counts = {r["_size"]: r["n"] for r in sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    begins: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first_pack = 0
    for pattern, uses in pack_patterns(counts, max_batch_len):
        for item, taken in pattern.items():
            begins.setdefault(item, []).append((used.get(item, 0), taken, first_pack))
            used[item] = used.get(item, 0) + taken * uses
        first_pack += uses
    rows = [(item, *stretch) for item in sorted(begins) for stretch in begins[item]]
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def pack_of(sizes: pd.Series, places: pd.Series) -> pd.Series:
        item, start, taken, pack = shared.value.T
        # Stretches are sorted by length and start, so a sample's is the last that is not after it.
        scale = int(start.max(initial=0)) + int(places.max() if len(places) else 0) + 1
        at = np.searchsorted(item * scale + start, sizes.to_numpy() * scale + places.to_numpy(), side="right") - 1
        return pd.Series(pack[at] + (places.to_numpy() - start[at]) // taken[at])

    placed = with_position(sized, list(order), keys=["_size"], position="_place", rows=sum(counts.values()))
    return placed.withColumn("pack", pack_of("_size", "_place")).drop("_size", "_place")


def packing_stats(packed: DataFrame, length: str, by: Sequence[str] = ("fit", "pack")) -> DataFrame:
    """Mean sample length, number of packs, mean samples per pack, fullest pack."""
    packs = packed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(length).alias("tokens")
    )
    return packs.agg(
        (F.sum("tokens") / F.sum("samples")).alias("avg_sample_len"),
        F.count(F.lit(1)).alias("num_batches"),
        (F.sum("samples") / F.count(F.lit(1))).alias("avg_samples_per_batch"),
        F.max("tokens").alias("longest_batch"),
    )


def take_first_n(df: DataFrame, order: Sequence[Column], n: int = fixed.REDUCED_TASKS) -> DataFrame:
    return df.orderBy(*order).limit(n)
