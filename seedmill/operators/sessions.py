"""Chat sessions as turn rows: history limits, earlier answers, retrieved context."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedmill.functions.ordering import with_position


def trim_history(
    turns: DataFrame,
    max_chars: int,
    key: str = "conv_id",
    text: str = "text",
    compat: bool = False,
) -> DataFrame:
    """Drop the oldest messages until the characters fit; the last message always stays.

    ``compat`` is the literal older behaviour: its running total is never reset,
    so a session over the limit shrinks to its last message.
    """
    length = F.length(text).cast("long")
    if compat:
        totals = turns.groupBy(key).agg(F.sum(length).alias("_total"), F.max("turn").alias("_last"))
        joined = turns.join(totals, key)
        return joined.filter(
            (F.col("_total") <= max_chars) | (F.col("turn") == F.col("_last"))
        ).select(*turns.columns)
    suffix = with_position(
        turns,
        [-F.col("turn")],
        keys=[key],
        running={"_suffix": length},
        position="_from_end",
    )
    return suffix.filter((F.col("_suffix") <= max_chars) | (F.col("_from_end") == 0)).select(
        *turns.columns
    )


def drop_oldest(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One step of the reaction to a context-length error: the oldest message goes, unless it is the only one."""
    ends = turns.groupBy(key).agg(F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    joined = turns.join(ends, key)
    return joined.filter(
        (F.col("turn") != F.col("_first")) | (F.col("_first") == F.col("_last"))
    ).select(*turns.columns)


def previous_response(turns: DataFrame, index: int = 1, key: str = "conv_id", text: str = "text") -> DataFrame:
    """The ``index``-th last answer per session, or null with ``error`` when the index is out of range.

    The answer is message ``2 * index - 1`` from the end. The rank filter has a
    constant bound, so each task hands on at most that many rows per session.
    """
    if index < 1:
        raise ValueError("index counts answers from the end, starting at 1")
    back = 2 * index - 1
    newest = Window.partitionBy(key).orderBy(F.desc("turn"))
    picked = (
        turns.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= back)
        .filter(F.col("_rank") == back)
        .select(key, F.col(text).alias("_answer"))
    )
    sizes = turns.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    outside = F.col("_n") <= back
    return sizes.join(picked, key, "left").select(
        key,
        F.when(~outside, F.col("_answer")).alias("response"),
        F.when(outside, F.lit(f"Invalid index: {index}")).alias("error"),
    )


def augment_sessions(turns: DataFrame, context: DataFrame, key: str = "conv_id") -> DataFrame:
    """Insert retrieved context as an assistant message right before its user message.

    ``context`` is ``(key, turn, context)``. Turns are renumbered in steps of
    two, which keeps the order without ranking the session.
    """
    user_turns = turns.filter(F.col("role") == "user").select(key, "turn")
    inserted = user_turns.join(context, [key, "turn"], "inner").select(
        key,
        (F.col("turn") * 2 - 1).alias("turn"),
        F.lit("assistant").alias("role"),
        F.col("context").alias("text"),
    )
    spaced = turns.select(key, (F.col("turn") * 2).alias("turn"), "role", "text")
    return spaced.unionByName(inserted)
