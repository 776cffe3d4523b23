"""Job registry rows: filters, current state, runtimes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedmill.functions.columns import elapsed_seconds, is_completed, runtime_text, whole_days


def filter_jobs(
    jobs: DataFrame,
    uuid: str | None = None,
    state: str | None = None,
    older: int | None = None,
    now: Column | None = None,
) -> DataFrame:
    """All conditions are optional; ``older`` counts whole elapsed days and 0 keeps every job."""
    out = jobs
    if uuid:
        out = out.filter(F.col("uuid") == uuid)
    if state:
        out = out.filter(F.col("status") == state)
    if older:
        moment = F.current_timestamp() if now is None else now
        out = out.filter(whole_days(F.col("start_time"), moment) >= older)
    return out


def list_jobs(jobs: DataFrame, selected: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Listing columns of the jobs, or of those whose uuid is in ``selected``."""
    shown = jobs if selected is None else jobs.join(selected.select("uuid").distinct(), "uuid", "left_semi")
    end = F.col("end_time") if now is None else F.coalesce(F.col("end_time"), now)
    return shown.withColumn(
        "runtime", runtime_text(elapsed_seconds(F.col("start_time"), end))
    ).withColumn("completed", is_completed(F.col("status")))


def latest_job(jobs: DataFrame, order: str = "added") -> DataFrame:
    """The job added last; no row for an empty registry."""
    return jobs.agg(F.max_by("uuid", order).alias("uuid")).filter(F.col("uuid").isNotNull())


def latest_per_key(changes: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Last recorded values per key, combined inside each task before anything moves."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return changes.groupBy(key).agg(last.alias("_last")).select(
        key, *[F.col(f"_last.{v}").alias(v) for v in values]
    )


def current_status(changes: DataFrame, key: str = "uuid", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Status per job from its changes. The first Done or Errored is final; later changes do not undo it."""
    at = F.struct(*order)
    final = is_completed(F.col("status"))
    folded = changes.groupBy(key).agg(
        F.min("ts").alias("start_time"),
        F.max_by("status", at).alias("_last"),
        F.min_by(F.when(final, F.col("status")), F.when(final, at)).alias("_final"),
        F.min(F.when(final, F.col("ts"))).alias("end_time"),
        F.count(F.lit(1)).alias("changes"),
    )
    return folded.select(
        key,
        F.coalesce("_final", "_last").alias("status"),
        "start_time",
        "end_time",
        "changes",
    )
