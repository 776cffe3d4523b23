"""Readers and writers on real folders."""

import json
import os
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seedmill.functions.slots import judge_column
from seedmill.functions.storage import materialize, shared_folder
from seedmill.operators.catalog import dataset_listing, datasets_by_run
from seedmill.operators.generation import generate, seed_requests
from seedmill.plans import generation, readers
from seedmill.sources import files as fl
from seedmill.sources import records, sinks


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_dataset_listing(spark, tmp_path):
    for run in ("2025-01-01_120000", "2025-01-02_120000"):
        for name in (
            "test_modelA_2024-10-27T08_34_48.jsonl",
            "skills_train_msgs_2024-10-27T08_34_48.jsonl",
            "node_datasets/compositional_skills_valid.jsonl",
            "notes.txt",
        ):
            path = tmp_path / run / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("test content")
    (tmp_path / "top.jsonl").write_text("x")
    catalog = records.list_datasets(spark, [str(tmp_path)])
    got = [(r["dataset"], r["model"], r["size"]) for r in dataset_listing(catalog).collect()]
    assert got[0] == ("top.jsonl", "General", "1.00 B")
    assert [g[0] for g in got[1:4]] == [
        "2025-01-02_120000/node_datasets/compositional_skills_valid.jsonl",
        "2025-01-02_120000/skills_train_msgs_2024-10-27T08_34_48.jsonl",
        "2025-01-02_120000/test_modelA_2024-10-27T08_34_48.jsonl",
    ]
    assert got[3][1:] == ("modelA", "12.00 B")
    assert {r["run_id"]: r["datasets"] for r in datasets_by_run(catalog).collect()} == {
        "2025-01-01_120000": 3, "2025-01-02_120000": 3, "top.jsonl": 1,
    }
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        records.list_datasets(spark, [str(tmp_path / "missing")]).collect()


def test_listing_never_opens_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x")
    plan = fl.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_folder_sizes(spark, tmp_path):
    for name, size in (("m/one/a.bin", 1500), ("m/one/b.bin", 548), ("m/two/c.bin", 10)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"0" * size)
    files = fl.list_files(spark, str(tmp_path)).withColumn("path", fl.relative_to(F.col("path"), str(tmp_path)))
    assert {r["folder"]: (r["bytes"], r["files"]) for r in fl.size_by_folder(files).collect()} == {
        "m/one": (2048, 2), "m/two": (10, 1),
    }
    assert {r["folder"]: r["bytes"] for r in fl.size_by_folder(files, depth=1).collect()} == {"m": 2058}


def listing(spark, *rows):
    data = [(p, datetime(2025, 1, d)) for p, d in rows]
    return spark.createDataFrame(data, "path string, modificationTime timestamp")


def test_latest_processed_folder(spark):
    good = listing(spark, ("first/docling-artifacts/a.json", 1), ("second/docling-artifacts/a.json", 2))
    assert fl.latest_processed_folder(good).first()["folder"] == "second/docling-artifacts"
    bad = listing(spark, ("first/docling-artifacts/a.json", 1), ("second/a.json", 2))
    assert fl.latest_processed_folder(bad).first()["folder"] is None
    assert fl.latest_processed_folder(good.limit(0)).first()["folder"] is None


def test_latest_train_test(spark):
    files = listing(
        spark, ("run1/train_a.jsonl", 1), ("run2/train_b.jsonl", 2), ("train_top.jsonl", 9),
        ("run1/test_a.jsonl", 1), ("run1/deep/test_z.jsonl", 9), ("test_gen.jsonl", 8), ("run1/train_gen.jsonl", 8),
    )
    got = fl.latest_train_test(files, exclude=("train_gen.jsonl", "test_gen.jsonl"))
    assert {r["kind"]: r["path"] for r in got.collect()} == {"train": "run2/train_b.jsonl", "test": "run1/test_a.jsonl"}
    assert fl.newest_test_file(files).first()["path"] == "test_gen.jsonl"
    fl.require_files(got)
    with pytest.raises(FileNotFoundError):
        fl.require_files(fl.latest_train_test(files.filter("path like '%train%'")))


def test_documents_of_one_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("# B")
    got = fl.read_documents(spark, str(tmp_path)).collect()
    assert [os.path.basename(r["path"]) for r in got] == ["a.md"]
    assert bytes(got[0]["content"]) == b"# A"


def test_questions(spark, tmp_path):
    good = [{"user_input": "q", "reference": "r"}]
    plain = records.read_questions(spark, write_lines(tmp_path / "a.jsonl", good))
    assert plain.columns == ["user_input", "reference"]
    full = records.read_questions(spark, write_lines(tmp_path / "b.jsonl", [good[0] | {"response": "x"}]))
    assert full.first()["response"] == "x"
    with pytest.raises(ValueError, match="jsonl"):
        records.read_questions(spark, write_lines(tmp_path / "a.json", good))
    with pytest.raises(ValueError, match="required"):
        records.read_questions(spark, write_lines(tmp_path / "c.jsonl", [{"user_input": "q"}]))
    broken = tmp_path / "d.jsonl"
    broken.write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        records.read_questions(spark, str(broken))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        records.read_questions(spark, str(tmp_path / "none.jsonl"))
    folder = tmp_path / "folder.jsonl"
    folder.mkdir()
    with pytest.raises(ValueError, match="directory"):
        records.read_questions(spark, str(folder))


def test_converted_documents(spark, tmp_path):
    newer = {
        "schema_name": "Document", "name": "new",
        "origin": {"mimetype": "application/pdf", "binary_hash": 13905043852393090531, "filename": "new.pdf"},
        "texts": [{"label": "section_header", "text": "Head"}, {"label": "text", "text": "Body"}],
    }
    older = {
        "_name": "", "file-info": {"filename": "old.pdf", "document-hash": "h"},
        "main-text": [{"type": "subtitle-level-1", "text": "Head"}, {"type": "paragraph", "text": "Body"}],
    }
    write_lines(tmp_path / "top.json", [newer])
    assert records.read_converted_docs(spark, str(tmp_path)).count() == 1
    write_lines(tmp_path / "docling-artifacts" / "new.json", [newer])
    write_lines(tmp_path / "docling-artifacts" / "old.json", [older])
    (tmp_path / "docling-artifacts" / "bad.json").write_text("{}")
    got = {r["doc_stem"]: r for r in records.parse_converted_docs(records.read_converted_docs(spark, str(tmp_path))).collect()}
    assert set(got) == {"new", "old", "bad"}
    assert int(got["new"]["origin"]["binary_hash"]) == 13905043852393090531
    assert [(i["label"], i["text"]) for i in got["old"]["items"]] == [("section_header", "Head"), ("paragraph", "Body")]
    assert got["old"]["origin"]["filename"] == "old.pdf"
    assert got["bad"]["items"] is None


def test_converted_documents_are_listed_by_folder(spark, tmp_path):
    for name in ("a b", "a c", "d"):
        for n in range(40):
            write_lines(tmp_path / name / f"{n} %.json", [{"n": n}])
        (tmp_path / name / "other.txt").write_text("{}")
        write_lines(tmp_path / name / "below" / "x.json", [{"n": -1}])
        write_lines(tmp_path / name / "part=1" / "x.json", [{"n": -1}])
    docs = records.read_converted_docs(spark, str(tmp_path / "a b"))
    assert "InMemoryFileIndex(1 paths)" in docs._jdf.queryExecution().executedPlan().toString()
    assert sorted(json.loads(r["content"])["n"] for r in docs.collect()) == list(range(40))
    assert records.read_converted_docs(spark, str(tmp_path / "a*")).count() == 80
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_converted_docs(spark, str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_converted_docs(spark, str(tmp_path / "none"))


def test_job_registry(spark, tmp_path):
    registry = {
        "u1": {"pid": 1, "children_pids": [2, 3], "type": "Generation", "log_file": "/l/1",
               "start_time": "2025-01-01T10:00:00", "status": "Running"},
        "u2": {"pid": 4, "children_pids": [], "type": "Training", "log_file": "/l/2",
               "start_time": "2025-01-01T10:00:00.250000", "status": "Done", "end_time": "2025-01-01T11:00:00"},
    }
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(registry))
    jobs = records.read_job_registry(spark, str(path)).orderBy("added").collect()
    assert [(j["uuid"], j["added"], j["status"]) for j in jobs] == [("u1", 0, "Running"), ("u2", 1, "Done")]
    assert jobs[0]["children_pids"] == [2, 3] and jobs[0]["end_time"] is None
    assert jobs[1]["end_time"] == datetime(2025, 1, 1, 11)


def test_sessions(spark, tmp_path):
    path = tmp_path / "chat.json"
    path.write_text(json.dumps([{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}], indent=4))
    turns = records.read_session(spark, str(path))
    assert [tuple(r) for r in turns.orderBy("turn").collect()] == [
        ("chat", 0, "user", "hi"), ("chat", 1, "assistant", "ho"),
    ]
    odd = turns.unionByName(spark.createDataFrame([("a/b c+d%é", 0, "user", "line\nbreak")], turns.schema))
    sinks.write_session(odd, str(tmp_path / "out"))
    back = records.read_session(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, odd.collect()))


def test_sessions_share_files(spark, tmp_path):
    rows = [(f"s {i}", t, "user", f"{i}\n{t}") for i in range(300) for t in (0, 1)]
    turns = spark.createDataFrame(rows, "session_id string, turn long, role string, content string")
    sinks.write_session(turns, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("part-*"))) <= 16
    sinks.write_session(turns.filter("session_id < 's 101'"), str(tmp_path / "single"), single=True)
    assert len(list((tmp_path / "single").rglob("part-*"))) == 4
    # Files of both kinds in one folder; only those with a session each are read as one value.
    shutil.copytree(tmp_path / "single", tmp_path / "out" / "single")
    back = records.read_session(spark, str(tmp_path / "out"))
    few = [r for r in rows if r[0] < "s 101"]
    assert sorted(map(tuple, back.collect())) == sorted(rows + few)


def test_parts_name_one_request_each(spark):
    rows = [("p", 0, 0, "same", "x"), ("p", 0, 1, "same", "y"), ("p|0", 0, 1, "same", "z")]
    seeds = spark.createDataFrame(rows, "path string, example int, pair int, question string, answer string")
    requests = seed_requests(seeds, 2)
    assert requests.select("request_id").distinct().count() == 6
    columns = "request_id string, question string, answer string, path string"
    assert generate(requests, schema=columns).count() == 6
    twice = requests.union(requests).withColumn("request_id", F.lit("one"))
    with pytest.raises(Exception, match="more than one request"):
        generate(twice, schema=columns).collect()


def test_choice_tasks(spark, tmp_path):
    (tmp_path / "_default_choice_template_yaml").write_text(
        'task: choice\ndoc_to_text: "{{question}}"\ngroup: choice\n'
    )
    data = write_lines(tmp_path / "t.jsonl", [{"question": "q", "choices": ["a", "b"], "answer": "A"}])
    (tmp_path / "rivers_task.yaml").write_text(
        f"dataset_kwargs:\n  data_files:\n    test: {data}\ninclude: _default_choice_template_yaml\ntask: rivers\n"
    )
    task = records.read_mc_tasks(spark, str(tmp_path)).collect()
    assert [(t["task"], t["group_name"], t["template"]) for t in task] == [("rivers", "choice", "{{question}}")]
    assert records.read_mc_questions(spark, task[0]["data_file"]).first()["choices"] == ["a", "b"]


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("q1", 'say "x", y', 5), ("q2", None, 2)], "user_input string, response string, scores int")
    moment = datetime(2025, 1, 2, 3, 4, 5)
    written = sinks.write_results(df, ["jsonl", "csv", "xlsx"], str(tmp_path) + "/", "model", moment)
    assert [w.rsplit(".", 1)[1] for w in written] == ["jsonl", "csv", "xlsx"]
    assert all(w.startswith(f"{tmp_path}/model/results_2025-01-02T03-04-05") for w in written)
    for stored in (spark.read.json(written[0]), spark.read.csv(written[1], header=True, escape='"')):
        rows = {r["user_input"]: r for r in stored.collect()}
        assert rows["q1"]["response"] == 'say "x", y' and rows["q2"]["response"] is None
        assert int(rows["q1"]["scores"]) == 5 and rows["q1"]["model_name"] == "model"
    assert spark.read.csv(written[2] + "/summary", header=True).count() == 5
    with pytest.raises(ValueError, match="choose from"):
        sinks.write_results(df, ["pdf"], str(tmp_path), "model")


def test_results_ask_the_judge_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def judge(asked, expected, given):
        calls.add(len(asked))
        return asked.str.len().astype("int32")

    df = spark.createDataFrame([("q",), ("qq",)], "user_input string").coalesce(1)
    scores = judge_column(judge, F.col("user_input"), F.col("user_input"), F.col("user_input"))
    sinks.write_results(df.withColumn("scores", scores), ["jsonl", "csv", "xlsx"], str(tmp_path), "m")
    assert calls.value == 2


def test_converted_output_and_report(spark, tmp_path):
    data = [("a", "success"), ("b", "partial"), ("c", "failure")]
    df = spark.createDataFrame(data, "doc_stem string, status string")
    assert tuple(sinks.write_converted(df, str(tmp_path / "out")).first()) == (1, 1, 1)
    sinks.write_converted(df.filter("doc_stem = 'a'"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("a",)]


def test_runs_and_splits(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("test").alias("split"))
    target = sinks.write_run(df, str(tmp_path / "runs"), datetime(2025, 1, 2, 3, 4, 5))
    assert target.endswith("/2025-01-02_030405") and spark.read.json(target).count() == 10
    sinks.write_splits(df, str(tmp_path / "splits"))
    stored = spark.read.schema("id long, split string").json(str(tmp_path / "splits"))
    plan = stored.filter("split = 'test'")
    assert plan.count() == 3
    assert "PartitionFilters: [isnotnull(split" in plan._jdf.queryExecution().executedPlan().toString()


def test_small_nodes_of_a_run_get_one_file_each(spark, tmp_path):
    # Texts that do not shrink: 40 nodes of some 20 KB, and one of some 400 KB.
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{n}")), 512) for n in range(4)])
    df = spark.range(0, 2400, 1, 8).select(
        F.lit("skills").alias("kind"),
        F.when(F.col("id") % 3 == 0, "large").otherwise(F.concat(F.lit("n"), (F.col("id") % 40).cast("string"))).alias("node"),
        text.alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        target = sinks.write_run(df, str(tmp_path), kinds=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {
        name: [f for f in os.listdir(f"{target}/kind=skills/{name}") if f.endswith(".json")]
        for name in os.listdir(f"{target}/kind=skills")
    }
    large = files.pop("node=large")
    assert len(files) == 40 and {len(f) for f in files.values()} == {1} and len(large) > 1
    assert sorted(r["text"] for r in spark.read.json(target).collect()) == sorted(r["text"] for r in df.collect())


def test_the_run_of_the_query_is_packed_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    seeds = spark.createDataFrame(
        [(f"knowledge/leaf{i}/qna.yaml", 0, 0, f"q{i}", f"a{i}") for i in range(3)],
        "path string, example int, pair int, question string, answer string",
    )
    monkeypatch.setattr(generation, "seeds", lambda *_: seeds)
    monkeypatch.setattr(generation, "scratch_path", lambda *_: str(tmp_path / "runs"))
    cleanup = []
    balanced = sinks.shuffles_removed
    monkeypatch.setattr(sinks, "shuffles_removed", lambda session: cleanup.append(session) or balanced(session))
    got = sorted(tuple(r) for r in generation.write_run(spark, "").collect())
    assert got == [("knowledge", f"knowledge_leaf{i}", 30) for i in range(3)]
    written = [f for _, _, files in os.walk(tmp_path / "runs") for f in files if f.startswith("part-")]
    assert len(written) == 3 and all(f.endswith(".json.gz") for f in written) and len(cleanup) == 1
    stored = spark.read.json(f"{tmp_path}/runs/*")
    assert stored.count() == 90 and {r["messages"][2]["content"] for r in stored.collect()} == {
        f"[{n}] a{i}" for n in range(1, 31) for i in range(3)
    }


def test_index_is_rebuilt_and_appended(spark, tmp_path):
    uri = str(tmp_path / "index")
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    assert sinks.write_index(docs, uri) == (True, 2)
    assert sinks.write_index(docs.limit(1), uri) == (True, 1)
    more = spark.createDataFrame(
        [("a", "x", 1), ("b", "y", 2), ("c", "later", 4), ("c", "first", 3)], "id string, content string, n int"
    )
    assert sinks.append_index(more, uri, "n") == 3
    assert spark.read.parquet(uri).filter("id = 'c'").first()["content"] == "first"
    kept = docs.withColumn("id", F.raise_error(F.lit("no")).cast("string"))
    assert sinks.write_index(kept, uri) == (False, -1)
    assert spark.read.parquet(uri).count() == 3
    broken = docs.withColumn("id", F.raise_error(F.lit("no")).cast("string"))
    assert sinks.write_index(broken, str(tmp_path / "broken")) == (False, -1)


def test_stored_table_has_a_short_lineage(spark):
    df = spark.range(5).withColumn("x", F.md5(F.col("id").cast("string")))
    stored = materialize(df, "t")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, df.collect()))
    assert "md5" not in stored._jdf.queryExecution().toString()
    assert shared_folder(spark)


def test_whole_texts_pass_through_the_document_reader(spark, tmp_path, monkeypatch):
    texts = ["one\nof two lines\r\n", "日本語 \u00a0 é", "long " * 100_000, "\"quoted\" \\n", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    read, seen = fl.read_documents, []

    def watched(*args):
        seen.append(read(*args))
        return seen[-1]

    monkeypatch.setattr(readers.fl, "read_documents", watched)
    got = readers.read_documents(spark, str(tmp_path)).collect()
    assert sorted(r.digest or "" for r in got) == sorted(r.d or "" for r in rows.select(F.md5("text").alias("d")).collect())
    assert sum(len(r.content) for r in seen[0].collect()) > sum(len((t or "").encode()) for t in texts)
