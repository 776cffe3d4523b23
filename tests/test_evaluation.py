"""Score comparison, reports, checkpoints and scalar functions on known values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seedmill.functions import columns as c
from seedmill.functions.slots import judge_column, overlap_score
from seedmill.operators import evaluation as ev


CANDIDATE = {"birds": [4.0, 5.0], "canals": [2.5], "dikes": [3.0], "eels": [1.5, 2.5], "ferries": [7.0]}
BASE = {"birds": [4.0], "canals": [3.5, 4.5], "dikes": [3.0], "eels": [0.5]}


def pairs(spark, scores):
    """Judged answers, some files with more than one."""
    rows = [(f"{name}/qna.yaml", score) for name, judged in scores.items() for score in judged]
    return spark.createDataFrame(
        [(n, score, name) for n, (name, score) in enumerate(rows)], "question_id long, score double, qna_file string"
    )


def lines(ranked, key):
    got = ev.report_lines(ranked, key).orderBy("change", "rank").collect()
    return {k: [r["line"] for r in got if r["change"] == k] for k in {r["change"] for r in got}}


def test_skill_report(spark):
    compared = ev.compare_to_base(
        ev.avg_score_by_qna(pairs(spark, CANDIDATE)), ev.avg_score_by_qna(pairs(spark, BASE))
    )
    ranked = ev.rank_improvements(compared, [F.col("qna_file")])
    assert lines(ranked, "qna_file") == {
        "improvement": ["1. eels/qna.yaml: 0.5 -> 2.0 (+1.5)", "2. birds/qna.yaml: 4.0 -> 4.5 (+0.5)"],
        "regression": ["1. canals/qna.yaml: 4.0 -> 2.5 (-1.5)"],
        "no change": ["1. dikes/qna.yaml (3.0)"],
        "new": ["1. ferries/qna.yaml (7.0)"],
    }


def test_task_without_base_is_an_error(spark):
    candidate = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "task string, score double")
    assert ev.compare_tasks(candidate, candidate).count() == 2
    with pytest.raises(Exception, match="no base score for b"):
        ev.compare_tasks(candidate, candidate.filter("task = 'a'")).collect()


def test_regressions_start_with_the_largest_loss(spark):
    data = [("a", 0.9, 0.5), ("b", 0.9, 0.1), ("c", 0.1, 0.9), ("d", 0.1, 0.3)]
    df = spark.createDataFrame(data, "f string, base double, score double")
    compared = ev.compare_to_base(
        df.select("f", F.col("score").alias("s")), df.select("f", F.col("base").alias("s")), "f", "s"
    )
    got = {r["f"]: r["rank"] for r in ev.rank_improvements(compared, [F.col("f")]).collect()}
    assert got == {"b": 1, "a": 2, "c": 1, "d": 2}


def test_rubric_report_and_summary(spark):
    df = spark.createDataFrame([("q1", 5), ("q2", 4), ("q3", 2), ("q4", 2)], "user_input string, scores int")
    report = ev.dk_report(df).first()
    assert (report["total_score"], report["max_score"], report["average_text"]) == (13, 20, "3.25/5")
    got = {r["metric"]: r["value"] for r in ev.results_summary(df, [F.col("user_input")]).collect()}
    assert got == {
        "Average": 3.25, "Total Score": 13.0, "Median": 3.0, "Q1": 5.0, "Q2": 4.0, "Q3": 2.0, "Q4": 2.0,
    }


def test_turn_scores_without_second_turn(spark):
    df = spark.createDataFrame([(1, 6.0), (1, None)], "turn int, score double")
    row = ev.turn_scores(df).first()
    assert (row["overall_score"], row["turn_one"], row["turn_two"], row["error_rate"]) == (6.0, 6.0, None, 0.5)
    clean = ev.turn_scores(df.filter("score is not null"))
    assert ev.combined_error_rate(clean, clean).count() == 0
    assert ev.combined_error_rate(clean, ev.turn_scores(df)).first()["error_rate"] == 0.25


def test_loss_is_weighted_by_tokens(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 3)], "loss double, tokens int")
    row = ev.weighted_mean_loss(df).first()
    assert row["loss"] == 2.5 and abs(row["perplexity"] - 12.182493960703473) < 1e-9


def test_accuracy_has_one_total_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1)], "task string, correct int")
    assert {r["task"]: r["acc"] for r in ev.task_accuracy(df).collect()} == {"a": 0.5, "b": 1.0, None: 0.75}


def test_last_answer_of_a_repeated_question(spark):
    data = [("q", "m1", "old", 1), ("q", "m1", "new", 2), ("q", "m2", "x", 3), ("r", "m2", "y", 4)]
    df = spark.createDataFrame(data, "question string, model string, answer string, n int")
    got = {r["question"]: (r["m1"], r["m2"]) for r in ev.answers_by_model(df, ["m1", "m2"], "n").collect()}
    assert got == {"q": ("new", "x"), "r": (None, "y")}


def test_shortest_side_ends_before_after(spark):
    test = spark.createDataFrame([(i, f"u{i}", f"a{i}") for i in range(3)], "n int, user string, assistant string")
    old = spark.createDataFrame([(9, "o0"), (11, "o1")], "n int, answer string")
    new = spark.createDataFrame([(5, "n0"), (6, "n1"), (7, "n2")], "n int, answer string")
    got = sorted(tuple(r) for r in ev.before_after(test, old, new, "n").collect())
    assert got == [(0, "u0", "a0", "o0", "n0"), (1, "u1", "a1", "o1", "n1")]


def test_checkpoints(spark):
    every = spark.createDataFrame([("s_9",), ("s_10",), ("s_10",)], "checkpoint string")
    todo = ev.checkpoints_todo(every, every.filter("checkpoint = 's_9'"))
    assert [r[0] for r in todo.collect()] == ["s_10"]
    with pytest.raises(RuntimeError):
        ev.checkpoints_todo(every, every, required=True)
    assert ev.latest_checkpoint(every).first()["checkpoint"] == "s_10"
    with pytest.raises(FileNotFoundError):
        ev.latest_checkpoint(every.limit(0), required=True)
    at = datetime(2025, 1, 1)
    results = spark.createDataFrame(
        [("late", 0.7, at.replace(day=3)), ("early", 0.7, at), ("low", 0.1, at)],
        "checkpoint string, score double, ended_at_utc timestamp",
    )
    assert ev.best_checkpoint(results).first()["checkpoint"] == "early"


def test_questions_with_and_without_responses(spark):
    asked = spark.createDataFrame([("q", "r")], "user_input string, reference string")
    assert ev.needs_responses(asked)
    got = ev.answered(asked, F.lit("given"))
    assert not ev.needs_responses(got) and got.first()["response"] == "given"
    assert ev.answered(got, F.lit("other")).first()["response"] == "given"


def test_judges(spark):
    df = spark.createDataFrame([("q", "a b c d", "a b x"), ("q", "a b", "b a"), ("q", "a", "")], "q string, e string, g string")
    assert [r[0] for r in df.select(overlap_score(F.col("e"), F.col("g"))).collect()] == [3, 5, 1]
    user = judge_column(lambda q, e, g: (e == g).astype("int32") + 1, F.col("q"), F.col("e"), F.col("g"))
    assert [r[0] for r in df.select(user).collect()] == [1, 1, 1]


@pytest.mark.parametrize(
    "value,want",
    [(0.125, 0.12), (2.675, 2.67), (0.375, 0.38), (-0.125, -0.12), (1.005, 1.0), (3.0, 3.0), (1234.567, 1234.57)],
)
def test_round2_is_exact(spark, value, want):
    assert round(value, 2) == want
    assert spark.range(1).select(c.round2(F.lit(value))).first()[0] == want


@pytest.mark.parametrize(
    "size,two,one",
    [(12, "12.00 B", "12.0 B"), (1023, "1023.00 B", "1023.0 B"), (2000, "1.95 KB", "2.0 KB"),
     (1024**2, "1.00 MB", "1.0 MB"), (3 * 1024**4, "3072.00 GB", "3072.0 GB"), (2304, "2.25 KB", "2.2 KB")],
)
def test_human_size(spark, size, two, one):
    row = spark.range(1).select(c.human_size(F.lit(size)), c.human_size(F.lit(size), 1)).first()
    assert tuple(row) == (two, one)


@pytest.mark.parametrize(
    "name,model",
    [("train_modelA_2024-10-27T08_34_48.jsonl", "modelA"),
     ("skills_train_msgs_2024-10-27T08_34_48.jsonl", "General"),
     ("test_mistral-7b.Q4_K_M_2024-11-12T02_37_38.jsonl", "mistral-7b.Q4_K_M")],
)
def test_model_name(spark, name, model):
    assert spark.range(1).select(c.model_name_from_file(F.lit(name))).first()[0] == model


@pytest.mark.parametrize(
    "seconds,text", [(0, "00:00:00"), (3661, "01:01:01"), (86399, "23:59:59"), (90061, "1d 01:01:01")]
)
def test_runtime_text(spark, seconds, text):
    assert spark.range(1).select(c.runtime_text(F.lit(seconds).cast("long"))).first()[0] == text


@pytest.mark.parametrize(
    "text,count", [("", 0), ("  \n\t ", 0), ("a", 1), (" a  b\tc\nd ", 4), ("a\u00a0b\u3000c\x0b", 3)]
)
def test_words(spark, text, count):
    assert spark.range(1).select(c.word_count(F.lit(text))).first()[0] == count


@pytest.mark.parametrize(
    "place,kind",
    [("docker://quay.io/org/model:latest", "oci"), ("docker://bad", "unknown"), ("owner/model", "owner/model"),
     ("my.bucket-1", "s3"), ("a b", "unknown"), ("x" * 256, "unknown")],
)
def test_classify_repo(spark, place, kind):
    assert spark.range(1).select(c.classify_repo(F.lit(place))).first()[0] == kind


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("*.md", "a.md", True), ("*.md", "d/a.md", False), ("docs/*.md", "docs/a.md", True),
     ("*.md", ".hidden.md", False), ("a?.txt", "ab.txt", True), ("a?.txt", "a/.txt", False),
     ("[ab].md", "b.md", True), ("[!ab].md", "b.md", False), ("[!ab].md", "c.md", True),
     ("a+b(1).md", "a+b(1).md", True), ("**/x.md", "d/x.md", True), ("**/x.md", "d/e/x.md", False)],
)
def test_glob(spark, pattern, path, hit):
    row = spark.createDataFrame([(pattern, path)], "g string, p string")
    assert row.select(F.rlike(F.col("p"), c.glob_to_regex(F.col("g")))).first()[0] is hit


def test_path_functions(spark):
    row = spark.range(1).select(
        c.base_name(F.lit("/a/b/c.tar.gz/")), c.file_stem(F.lit("x/doc.v1.json")), c.file_stem(F.lit("x/.env")),
        c.file_suffix(F.lit("x/doc.md")), c.file_suffix(F.lit("x.d/doc")), c.run_id_from_path(F.lit("only.jsonl")),
    ).first()
    assert tuple(row) == ("c.tar.gz", "doc.v1", ".env", ".md", "", "only.jsonl")
