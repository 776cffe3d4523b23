"""Streaming forms: new run folders, job status changes, counts per time window."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seedmill import schemas
from seedmill.operators.jobs import current_status
from seedmill.operators.messages import to_legacy


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Message datasets of run folders as they arrive."""
    return (
        spark.readStream.schema(schemas.MESSAGE_SAMPLE)
        .option("recursiveFileLookup", True)
        .json(folder)
    )


def stream_to_legacy(messages: DataFrame) -> DataFrame:
    """Arriving samples in the legacy layout, each judged on its own; bad rows carry their error."""
    return to_legacy(messages, on_error="quarantine", per_row=True)


def start_append(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run what has arrived and append it to a Parquet folder."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )


def job_status_changes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Status changes without repeats of the same event; state lasts as long as the delay."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def job_status_stream(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of each micro-batch; ``job_status_view`` folds them per job.

    A retried batch writes its own folder again, so its changes are there once.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        job_status_changes(events)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def job_status_view(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """Current state per job over the stored changes, by event time and not by arrival."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return current_status(reader.parquet(target))


def status_counts(
    events: DataFrame,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
    keys: tuple[str, ...] = ("type", "status"),
) -> DataFrame:
    """Events per time window and status; events later than the watermark are dropped.

    Works on a stream and on a table alike.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    bucket = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        timed.groupBy(bucket.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def session_counts(
    events: DataFrame, gap: str = "1 hour", watermark: str = "1 hour", key: str = "uuid"
) -> DataFrame:
    """Bursts of activity per job: a session ends after a gap without events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (
        timed.groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
    )


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    start().awaitTermination()


def session_counts_table(events: DataFrame, gap_seconds: int = 3600, key: str = "uuid") -> DataFrame:
    """``session_counts`` over a table.

    Events of one key closer than the gap always share a session, so they
    first collapse into one row per gap-wide slot. A busy key then has as many
    rows as there are slots in the covered time, however many events it holds.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = events.groupBy(key, (at - F.pmod(at, F.lit(gap))).alias("_slot")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    by_key = Window.partitionBy(key).orderBy("_slot")
    opens = F.when(F.col("_first") <= F.lag("_last").over(by_key) + gap, 0).otherwise(1)
    numbered = slots.withColumn("_opens", opens).withColumn(
        "_session", F.sum("_opens").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy(key, "_session").agg(
        F.timestamp_micros(F.min("_first")).alias("session_start"),
        F.timestamp_micros(F.max("_last") + gap).alias("session_end"),
        F.sum("_n").alias("n"),
    ).drop("_session")
