"""Streaming queries run to the end of the given tables, next to their batch twins."""

from pyspark.sql import functions as F

from seedmill.functions.storage import scratch_path
from seedmill.plans.jobs import FOLDED, folded
from seedmill.plans.messages import PRETRAINING, STANDARD, mixed_samples
from seedmill.plans.registry import query
from seedmill.plans.tables import CHANGES, job_changes, table
from seedmill.streaming import twins


def event_stream(spark, folder):
    """The events table as a file stream."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query(
    f"""WITH {PRETRAINING}, {STANDARD}
SELECT sample, system, "user", assistant, error FROM pretraining
UNION ALL SELECT -conv_id - 1, system, "user", assistant, error FROM standard"""
)
def stream_to_legacy(spark, folder):
    """Samples arrive in two run folders and come out in the legacy layout."""
    root = scratch_path(spark, "arriving")
    rows = mixed_samples(spark, folder).select(
        "messages",
        F.lit("g").alias("group"),
        F.lit("d").alias("dataset"),
        F.col("sample").cast("string").alias("metadata"),
    )
    rows.filter("metadata % 2 = 0").write.json(f"{root}/in/2025-01-01_120000")
    rows.filter("metadata % 2 <> 0").write.json(f"{root}/in/2025-01-02_120000")
    legacy = twins.stream_to_legacy(twins.stream_messages(spark, f"{root}/in"))
    twins.run_to_end(lambda: twins.start_append(legacy, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(legacy.schema).parquet(f"{root}/out").select(
        F.col("metadata").cast("long").alias("sample"), "system", "user", "assistant", "error"
    )


@query(FOLDED)
def job_status_stream(spark, folder):
    root = scratch_path(spark, "job-status-stream")
    changes = job_changes(event_stream(spark, folder))
    twins.run_to_end(lambda: twins.job_status_stream(changes, f"{root}/out", f"{root}/checkpoint"))
    return folded(twins.job_status_view(spark, f"{root}/out"))


COUNTS = f"""WITH {CHANGES} SELECT epoch_us(date_trunc('day', ts)) AS window_start, type, status, count(*) AS n
FROM changes GROUP BY 1, 2, 3"""


def _counts(frame):
    return frame.select(F.unix_micros("window_start").alias("window_start"), "type", "status", "n")


@query(COUNTS)
def status_counts(spark, folder):
    return _counts(twins.status_counts(job_changes(table(spark, folder, "events"))))


@query(
    f"""WITH {CHANGES}, slid AS (
  SELECT type, status, epoch_us(ts) // 43200000000 * 43200000000 - k * 43200000000 AS window_start
  FROM changes, range(0, 2) t(k))
SELECT window_start, type, status, count(*) AS n FROM slid GROUP BY ALL"""
)
def status_counts_sliding(spark, folder):
    return _counts(twins.status_counts(job_changes(table(spark, folder, "events")), slide="12 hours"))


@query(
    COUNTS.replace(
        "FROM changes GROUP",
        """FROM changes WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM changes) - INTERVAL 1 HOUR GROUP""",
    )
)
def status_counts_stream(spark, folder):
    """Append mode hands out a window once the watermark has passed its end."""
    root = scratch_path(spark, "status-counts")
    counted = twins.status_counts(job_changes(event_stream(spark, folder)))
    twins.run_to_end(lambda: twins.start_append(counted, f"{root}/out", f"{root}/checkpoint"))
    return _counts(spark.read.schema(counted.schema).parquet(f"{root}/out"))


SESSIONS = f"""WITH {CHANGES},
gaps AS (SELECT uuid, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
         FROM changes WINDOW w AS (PARTITION BY uuid ORDER BY ts, event_id)),
numbered AS (SELECT uuid, ts, sum(opens) OVER (PARTITION BY uuid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT uuid, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 21600000000 AS session_end, count(*) AS n
FROM numbered GROUP BY uuid, session"""


@query(SESSIONS)
def session_counts(spark, folder):
    sessions = twins.session_counts_table(job_changes(table(spark, folder, "events")), gap_seconds=6 * 3600)
    return sessions.select(
        "uuid", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n"
    )


@query(
    SESSIONS
    + """
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM changes) - INTERVAL 1 HOUR"""
)
def session_counts_stream(spark, folder):
    """Append mode hands out a session once the watermark has passed its end."""
    root = scratch_path(spark, "session-counts")
    counted = twins.session_counts(job_changes(event_stream(spark, folder)), "6 hours")
    twins.run_to_end(lambda: twins.start_append(counted, f"{root}/out", f"{root}/checkpoint"))
    sessions = spark.read.schema(counted.schema).parquet(f"{root}/out")
    return sessions.select(
        "uuid", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n"
    )
