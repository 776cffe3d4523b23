"""Queries on the job registry, which is built from events."""

from pyspark.sql import functions as F

from seedmill.functions.columns import elapsed_seconds, runtime_text, whole_days
from seedmill.functions.storage import scratch_path
from seedmill.operators import jobs as jb
from seedmill.plans.registry import query
from seedmill.plans.tables import CHANGES, JOBS, NOW, job_changes, jobs, table
from seedmill.sources import records, sinks


def now():
    return F.lit(NOW).cast("timestamp")


RUNTIME = """CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END
  || printf('%02d:%02d:%02d', s // 3600 % 24, s // 60 % 60, s % 60)"""


@query(
    f"""WITH {JOBS} SELECT uuid, type, status FROM jobs
WHERE status = 'Done' AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(start_time)) // 86400000000 >= 45"""
)
def filter_jobs(spark, folder):
    return jb.filter_jobs(jobs(spark, folder), state="Done", older=45, now=now()).select("uuid", "type", "status")


@query(f"WITH {JOBS} SELECT uuid, type, status FROM jobs WHERE status = 'Running'")
def filter_jobs_any_age(spark, folder):
    return jb.filter_jobs(jobs(spark, folder), state="Running", older=0).select("uuid", "type", "status")


@query(
    f"""WITH {JOBS}, timed AS (
  SELECT uuid, pid, type, status, status <> 'Running' AS completed,
         epoch_us(coalesce(end_time, TIMESTAMP '{NOW}')) // 1000000 - epoch_us(start_time) // 1000000 AS s FROM jobs)
SELECT uuid, pid, type, status, completed, {RUNTIME} AS runtime FROM timed"""
)
def list_jobs(spark, folder):
    listed = jb.list_jobs(jobs(spark, folder), now=now())
    return listed.select("uuid", "pid", "type", "status", "completed", "runtime")


@query(f"WITH {JOBS} SELECT uuid, type FROM jobs WHERE type = 'Training'")
def list_selected_jobs(spark, folder):
    every = jobs(spark, folder)
    return jb.list_jobs(every, every.filter("type = 'Training'"), now=now()).select("uuid", "type")


@query(
    f"""WITH {JOBS} SELECT uuid, epoch_us(TIMESTAMP '{NOW}') // 1000000 - epoch_us(start_time) // 1000000 AS seconds,
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(start_time)) // 86400000000 AS days FROM jobs"""
)
def job_ages(spark, folder):
    return jobs(spark, folder).select(
        "uuid",
        elapsed_seconds(F.col("start_time"), now()).alias("seconds"),
        whole_days(F.col("start_time"), now()).alias("days"),
    )


@query(f"WITH {JOBS} SELECT max_by(uuid, added) AS uuid FROM jobs")
def latest_job(spark, folder):
    return jb.latest_job(jobs(spark, folder))


@query(
    f"""WITH {CHANGES} SELECT uuid, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id
FROM changes GROUP BY uuid"""
)
def latest_per_key(spark, folder):
    changes = job_changes(table(spark, folder, "events"))
    return jb.latest_per_key(changes, "uuid", ["ts", "event_id"], ["status", "event_id"])


FOLDED = f"""WITH {CHANGES} SELECT uuid,
  coalesce(arg_min(status, (ts, event_id)) FILTER (WHERE status <> 'Running'), arg_max(status, (ts, event_id))) AS status,
  epoch_us(min(ts)) AS started, epoch_us(min(ts) FILTER (WHERE status <> 'Running')) AS ended, count(*) AS changes
FROM changes GROUP BY uuid"""


def folded(state):
    def micros(column):
        return F.unix_micros(F.col(column).cast("timestamp"))

    return state.select(
        "uuid", "status", micros("start_time").alias("started"), micros("end_time").alias("ended"), "changes"
    )


@query(FOLDED)
def current_status(spark, folder):
    return folded(jb.current_status(job_changes(table(spark, folder, "events"))))


@query(FOLDED)
def append_job_status(spark, folder):
    """Changes appended in two steps to day partitions; the state is a query on what is stored."""
    path = scratch_path(spark, "job-status")
    changes = job_changes(table(spark, folder, "events"))
    for half in (0, 1):
        sinks.append_job_status(changes.filter(F.col("event_id") % 2 == half), path)
    return folded(jb.current_status(spark.read.parquet(path)))


@query(
    f"""WITH {JOBS}, timed AS (
  SELECT uuid, pid, type, status, epoch_us(coalesce(end_time, TIMESTAMP '{NOW}')) // 1000000
         - epoch_us(start_time) // 1000000 AS s FROM jobs)
SELECT uuid, pid, type, status, {RUNTIME} AS runtime FROM timed"""
)
def read_job_registry(spark, folder):
    """Registry files, each one JSON object keyed by job id, of 500 jobs."""
    entry = F.struct(
        "pid",
        "type",
        F.concat(F.lit("/logs/"), "uuid", F.lit(".log")).alias("log_file"),
        F.array(F.col("pid") + 1).alias("children_pids"),
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"),
        "status",
        F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("end_time"),
    )
    registry = (
        jobs(spark, folder)
        .groupBy(F.floor(F.col("added") / 500).alias("part"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("uuid"), entry))).alias("jobs"))
        .select(F.to_json("jobs").alias("value"))
    )
    path = scratch_path(spark, "registry")
    registry.write.option("maxRecordsPerFile", 1).text(path)
    stored = records.read_job_registry(spark, path)
    runtime = runtime_text(elapsed_seconds(F.col("start_time"), F.coalesce(F.col("end_time"), now())))
    return stored.select("uuid", "pid", "type", "status", runtime.alias("runtime"))
