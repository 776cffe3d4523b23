"""Job states, and streaming forms against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seedmill.operators import jobs as jb
from seedmill.streaming import twins

START = datetime(2025, 1, 1)
CHANGES = "uuid string, type string, status string, ts timestamp, event_id long"


def at(hours):
    return START + timedelta(hours=hours)


@pytest.fixture
def jobs(spark):
    data = [
        ("u1", "Running", at(0), None, 0),
        ("u2", "Done", at(24), at(25.5), 1),
        ("u3", "Errored", at(47.9), at(48), 2),
    ]
    return spark.createDataFrame(
        data, "uuid string, status string, start_time timestamp, end_time timestamp, added long"
    )


@pytest.mark.parametrize(
    "conditions,left",
    [({}, "u1 u2 u3"), ({"uuid": "u2"}, "u2"), ({"state": "Running"}, "u1"), ({"older": 0}, "u1 u2 u3"),
     ({"older": 1}, "u1 u2"), ({"older": 2}, "u1"), ({"older": 3}, ""), ({"state": "Done", "older": 1}, "u2")],
)
def test_filters(jobs, conditions, left):
    got = jb.filter_jobs(jobs, now=F.lit(at(48.1)), **conditions)
    assert sorted(r["uuid"] for r in got.collect()) == left.split()


def test_listing(jobs):
    got = {r["uuid"]: (r["runtime"], r["completed"]) for r in jb.list_jobs(jobs, now=F.lit(at(30))).collect()}
    assert got == {"u1": ("1d 06:00:00", False), "u2": ("01:30:00", True), "u3": ("00:06:00", True)}
    assert jb.list_jobs(jobs, jobs.filter("uuid = 'u2'")).count() == 1
    assert jb.latest_job(jobs).first()["uuid"] == "u3"
    assert jb.latest_job(jobs.limit(0)).count() == 0


def test_first_end_is_final(spark):
    data = [("a", "T", "Running", at(0), 1), ("a", "T", "Errored", at(1), 2), ("a", "T", "Done", at(2), 3),
            ("b", "T", "Running", at(0), 4), ("b", "T", "Running", at(3), 5)]
    got = {r["uuid"]: (r["status"], r["end_time"]) for r in jb.current_status(spark.createDataFrame(data, CHANGES)).collect()}
    assert got == {"a": ("Errored", at(1)), "b": ("Running", None)}


def test_last_values_per_key(spark):
    data = [("a", "T", "x", at(1), 2), ("a", "T", "y", at(1), 3), ("a", "T", "z", at(0), 9)]
    got = jb.latest_per_key(spark.createDataFrame(data, CHANGES), "uuid", ["ts", "event_id"], ["status"])
    assert [tuple(r) for r in got.collect()] == [("a", "y")]


def test_late_and_repeated_events(spark, tmp_path):
    """Two arrivals: the second brings a repeat and an event far behind the watermark."""
    source = str(tmp_path / "in")
    schema = spark.createDataFrame([], CHANGES).schema

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def run(counted):
        twins.run_to_end(lambda: twins.start_append(counted, str(tmp_path / "out"), str(tmp_path / "mark")))

    arrive(("a", "T", "Running", at(1), 1), ("b", "T", "Running", at(2), 2), ("a", "T", "Done", at(60), 3))
    counted = twins.status_counts(spark.readStream.schema(schema).parquet(source), keys=("status",))
    run(counted)
    arrive(("late", "T", "Running", at(3), 4), ("c", "T", "Running", at(130), 5))
    run(counted)
    got = {(r["window_start"], r["status"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(START, "Running"): 2, (START + timedelta(days=2), "Done"): 1}

    changes = spark.readStream.schema(schema).parquet(source)
    arrive(("a", "T", "Done", at(129), 6), ("a", "T", "Done", at(129), 6))
    twins.run_to_end(lambda: twins.job_status_stream(changes, str(tmp_path / "states"), str(tmp_path / "mark2")))
    view = twins.job_status_view(spark, str(tmp_path / "states"))
    assert {r["uuid"]: (r["status"], r["changes"]) for r in view.collect()} == {
        "a": ("Done", 3), "b": ("Running", 1), "c": ("Running", 1), "late": ("Running", 1),
    }


def test_new_run_folders_are_picked_up(spark, tmp_path):
    from seedmill import schemas

    def arrive(run, *texts):
        rows = [([{"role": r, "content": t} for r in ("system", "user", "assistant")], "g", "d", t) for t in texts]
        spark.createDataFrame(rows, schemas.MESSAGE_SAMPLE).write.json(f"{tmp_path}/in/{run}")

    def run():
        legacy = twins.stream_to_legacy(twins.stream_messages(spark, f"{tmp_path}/in"))
        twins.run_to_end(lambda: twins.start_append(legacy, f"{tmp_path}/out", f"{tmp_path}/mark"))
        return sorted(r["user"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive("2025-01-01_120000", "one", "two")
    assert run() == ["one", "two"]
    arrive("2025-01-02_120000", "three")
    assert run() == ["one", "three", "two"]


@pytest.mark.parametrize("gap", [3600, 7200])
def test_sessions_equal_the_built_in_window(spark, gap):
    rows = [(f"u{i % 3}", "T", "Running", at((i * i * 37 % 1000) / 20), i) for i in range(200)]
    events = spark.createDataFrame(rows, CHANGES)
    columns = ["uuid", "session_start", "session_end", "n"]
    got = twins.session_counts_table(events, gap).select(*columns)
    want = twins.session_counts(events, f"{gap} seconds").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
