"""Requests, batches, resumption and training sets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedmill.functions.slots import run_generator, template_generator
from seedmill.operators import generation as gn


@pytest.fixture
def seeds(spark):
    paths = [f"knowledge/leaf{i % 2}/qna.yaml" if i < 4 else "compositional_skills/a/qna.yaml" for i in range(6)]
    data = [(path, i, 0, f"q{i}", f"a{i}") for i, path in enumerate(paths)]
    return spark.createDataFrame(data, "path string, example int, pair int, question string, answer string")


def test_scale_factor(seeds):
    requests = gn.seed_requests(seeds)
    assert requests.count() == 6 * 30
    assert requests.select("request_id").distinct().count() == 180
    assert sorted(r[0] for r in requests.select("repeat").distinct().collect()) == list(range(1, 31))


@pytest.mark.parametrize("batch,largest", [(8, 8), (0, 1), (3, 3)])
def test_batches_reach_the_generator(spark, seeds, batch, largest):
    def generator(frame):
        return frame[["request_id"]].assign(size=len(frame))

    got = gn.generate(gn.seed_requests(seeds, 10), generator, "request_id string, size long", batch)
    sizes = [r["size"] for r in got.collect()]
    assert len(sizes) == 60 and max(sizes) <= largest


@pytest.mark.parametrize("scale,batch", [(30, 8), (4, 8), (8, 1), (3, 0)])
def test_requests_dealt_by_batches_are_the_same(seeds, rows, scale, batch):
    got = gn.seed_requests(seeds, scale, batch)
    assert got.dtypes == gn.seed_requests(seeds, scale).dtypes
    assert rows(got) == rows(gn.seed_requests(seeds, scale))


def test_dealt_requests_are_repeated_after_they_travelled(spark, seeds):
    out = gn.generate(gn.seed_requests(seeds, 30, 8), dealt=True)
    text = out._jdf.queryExecution().executedPlan().toString()
    # From the top of the plan: the generator, the repeats, the one exchange, the batches.
    steps = [text.index("MapInPandas"), text.index("explode(sequence(_first"), text.index("Exchange"), text.rindex("explode(")]
    assert steps == sorted(steps) and text.count("Exchange") == 1
    spread = out.groupBy(F.spark_partition_id().alias("slot")).count().collect()
    assert sum(r["count"] for r in spread) == 180 and len(spread) > 4
    limited = gn.generate(gn.seed_requests(seeds, 30, 8), max_concurrency=2, dealt=True)
    assert limited.rdd.getNumPartitions() == 2 and limited.count() == 180


def test_several_outputs_per_request(seeds):
    import pandas as pd

    def twice(frame):
        return pd.concat([frame[["request_id"]].assign(text=t) for t in ("x", "y")])

    got = gn.generate(gn.seed_requests(seeds, 2), twice, "request_id string, text string, path string")
    assert got.count() == 24
    assert got.groupBy("path").count().count() == 3


def test_resume_adds_only_what_is_missing(spark, seeds, tmp_path):
    folder = str(tmp_path / "generated")
    calls = spark.sparkContext.accumulator(0)

    def generator(frame):
        calls.add(len(frame))
        return frame[["request_id"]].assign(question="q", answer="a")

    every = gn.seed_requests(seeds, 4)
    first = gn.generate_resumable(every.filter("repeat = 1"), folder, generator, slices=2)
    assert first.count() == 6 and calls.value == 6
    second = gn.generate_resumable(every, folder, generator, slices=2)
    assert second.count() == 24 and second.select("request_id").distinct().count() == 24
    assert calls.value == 24
    assert gn.resume_requests(every, second).count() == 0


def test_resuming_deals_requests_out_once(spark, seeds, tmp_path, monkeypatch):
    folder = str(tmp_path / "generated")
    every = gn.seed_requests(seeds, 4)
    plans = []

    def seen(df, *args):
        plans.append(df)
        return run_generator(df, *args)

    monkeypatch.setattr(gn, "run_generator", seen)
    monkeypatch.setattr(gn, "scratch_path", lambda *_: pytest.fail("requests of one slice are stored"))
    assert gn.generate_resumable(every.filter("repeat = 1"), folder).count() == 6
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = gn.generate_resumable(every, folder)
        assert got.count() == 24 and got.select("request_id").distinct().count() == 24
        text = plans[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of the requests, of a fixed number of partitions, and one of the stored ids.
    assert text.count("Exchange") == 2 and text.count("REPARTITION_BY_NUM") == 1
    assert gn.generate_resumable(every, folder).count() == 24


def test_outputs_leave_in_pieces(spark):
    def generator(frame):
        return frame[["request_id"]].assign(question="q", answer="a")

    requests = [pd.DataFrame({"request_id": [str(i) for i in range(5000)], "path": "p"})]
    found = {}

    class Frames:
        def mapInPandas(self, call, schema):  # noqa: N802
            found["pieces"] = list(call(requests))

    run_generator(Frames(), generator, "request_id string, question string, path string", 8)
    assert sum(map(len, found["pieces"])) == 5000 and max(map(len, found["pieces"])) <= 1024
    assert all(p["path"].eq("p").all() for p in found["pieces"])


def test_a_generator_gets_rows_numbered_from_0_that_are_not_copied(spark):
    requests = pd.DataFrame({"request_id": [str(i) for i in range(20)], "repeat": range(20), "question": "q", "answer": "a"})
    got = []

    def generator(frame):
        got.append((list(frame.index), np.shares_memory(frame["repeat"].to_numpy(), requests["repeat"].to_numpy())))
        return template_generator(frame)

    class Frames:
        def mapInPandas(self, call, schema):  # noqa: N802
            return pd.concat(call([requests]))

    out = run_generator(Frames(), generator, "request_id string, question string, answer string, repeat int", 8)
    assert got == [(list(range(8)), True), (list(range(8)), True), (list(range(4)), True)]
    assert out["question"].tolist() == [f"[{i}] q" for i in range(20)] and out["repeat"].tolist() == list(range(20))
    assert list(requests.index) == list(range(20))


def test_chunks_never_multiply_with_examples(spark):
    pair = "struct<question:string,answer:string>"
    files = spark.createDataFrame(
        [("en", [("q1", "a1"), ("q2", "a2"), ("q3", "a3")])], f"leaf string, examples array<{pair}>"
    )
    chunks = spark.range(1000).select(
        F.when(F.col("id") < 990, "en").otherwise("none").alias("leaf"),
        F.col("id").alias("chunk_id"),
        F.lit("text").alias("content"),
    )
    got = gn.knowledge_requests(files, chunks, scale=2)
    counts = {r["origin"]: r["count"] for r in got.groupBy("origin").count().collect()}
    assert counts == {"chunk": 990 * 2, "pair": 3 * 2}
    assert got.filter("origin = 'chunk'").select(F.size("examples")).distinct().first()[0] == 3
    assert got.select("request_id").distinct().count() == got.count()


def test_training_sets(seeds):
    generated = gn.generate(
        gn.seed_requests(seeds), schema="request_id string, question string, answer string, path string"
    )
    got = gn.to_training_messages(generated)
    assert {(r["kind"], r["node"]) for r in got.collect()} == {
        ("knowledge", "knowledge_leaf0"), ("knowledge", "knowledge_leaf1"), ("skills", "compositional_skills_a"),
    }
    roles = [m["role"] for m in got.first()["messages"]]
    assert roles == ["system", "user", "assistant"]
    again = {r["request_id"]: r["side"] for r in gn.to_training_messages(generated.repartition(5)).collect()}
    assert again == {r["request_id"]: r["side"] for r in got.collect()}
    assert 0 < sum(side == "test" for side in again.values()) < 60


def test_token_limit_and_word_budget(spark):
    df = spark.createDataFrame([("p", "a  b c", "x y")], "path string, answer string, question string")
    assert gn.limit_tokens(df, 2).first()["answer"] == "a b"
    assert gn.limit_tokens(df, 3).first()["answer"] == "a  b c"
    assert tuple(gn.seed_word_budget(df, 4).first()) == ("p", 5, True)
    assert gn.seed_word_budget(df, 5).first()["over_budget"] is False
