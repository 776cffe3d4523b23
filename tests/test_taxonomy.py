"""Seed files on disk: reading, checks, differences, flattening."""

import fnmatch
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from seedmill.operators import taxonomy as tx
from seedmill.sources.taxonomy import parse_seed_files, read_taxonomy


def skill(examples=5, author="team", answer="Howdy"):
    body = "".join(f"\n  - question: >\n      Howdy {i}?\n    answer: {answer}" for i in range(examples))
    return f"version: 3\ncreated_by: {author}\ntask_description: |\n  A skill\nseed_examples:{body}\n"


def knowledge(pattern="phoenix.md"):
    body = "".join(
        textwrap.indent(
            f"""- context: >
    Hello {i}
  questions_and_answers:
""" + "".join(f"    - question: Q{i}{j}\n      answer: A{j}\n" for j in range(3)),
            "  ",
        )
        for i in range(5)
    )
    return (
        "version: 3\ndomain: Hello\ncreated_by: team\ndocument_outline: outline\nseed_examples:\n"
        + body
        + f"document:\n  repo: https://host/data\n  commit: c87a\n  patterns:\n    - '{pattern}'\n"
    )


@pytest.fixture
def tree(tmp_path):
    files = {
        "compositional_skills/howdy/qna.yaml": skill(),
        "compositional_skills/few/qna.yaml": skill(1),
        "compositional_skills/bool/qna.yaml": skill(answer="Yes"),
        "compositional_skills/broken/qna.yaml": "a: [1",
        "compositional_skills/named/qna.yml": skill(),
        "compositional_skills/other/notes.txt": "x",
        "knowledge/hello/qna.yaml": knowledge(),
        "knowledge/text/qna.yaml": knowledge("*.txt"),
        "knowledge/none/qna.yaml": knowledge("missing*"),
        "elsewhere/qna.yaml": skill(),
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(tmp_path)


@pytest.fixture
def parsed(spark, tree):
    return read_taxonomy(spark, tree)


@pytest.fixture
def repo(spark):
    names = ["phoenix.md", "notes.txt", "book.pdf", "sub/deep.md"]
    return spark.createDataFrame([("https://host/data", n) for n in names], "repo string, path string")


def test_only_seed_files_are_read(parsed):
    paths = sorted(r["path"] for r in parsed.collect())
    assert paths == [
        "compositional_skills/bool/qna.yaml",
        "compositional_skills/broken/qna.yaml",
        "compositional_skills/few/qna.yaml",
        "compositional_skills/howdy/qna.yaml",
        "knowledge/hello/qna.yaml",
        "knowledge/none/qna.yaml",
        "knowledge/text/qna.yaml",
    ]


def test_nested_layout(parsed):
    row = parsed.filter("path = 'knowledge/hello/qna.yaml'").first()
    assert (row["version"], row["domain"], row["document"]["patterns"]) == (3, "Hello", ["phoenix.md"])
    assert [len(e["questions_and_answers"]) for e in row["seed_examples"]] == [3] * 5


def test_validation(parsed, repo):
    got = {r["path"].split("/")[1]: r["errors"] for r in tx.validate_seed_files(parsed, repo).collect()}
    assert got["howdy"] == [] and got["hello"] == []
    assert got["few"] == ["fewer than 5 seed examples"]
    assert got["bool"][0].startswith("not text: seed_examples[0].answer")
    assert got["broken"][0].startswith("unreadable")
    assert got["text"] == ["a matched document has a type that is not read"]
    assert got["none"] == ["no document matches"]


def test_documents_are_checked_only_when_clean(spark, repo):
    text = knowledge("missing*").replace("created_by: team\n", "")
    files = spark.createDataFrame([("knowledge/x/qna.yaml", text)], "path string, content string")
    row = tx.validate_seed_files(parse_seed_files(files), repo).first()
    assert row["errors"] == ["created_by is missing"]


def test_totals_raise(parsed, repo):
    validated = tx.validate_seed_files(parsed, repo)
    row = tx.validation_totals(validated).first()
    assert (row["files"], row["errors"]) == (7, 5)
    with pytest.raises(ValueError, match="7 seed files have 5 errors"):
        tx.require_valid(validated)
    clean = validated.filter("n_errors = 0")
    assert tx.require_valid(clean).first()["files"] == 2


def test_flat_and_nested_seeds(parsed):
    seeds = tx.explode_seeds(parsed)
    assert seeds.filter("path = 'knowledge/hello/qna.yaml'").count() == 15
    flat = seeds.filter("path = 'compositional_skills/howdy/qna.yaml'")
    assert flat.count() == 5
    first = flat.orderBy("example").first()
    assert (first["context"], first["question"], first["answer"]) == (None, "Howdy 0?\n", "Howdy")


def test_matching_stays_in_the_repository(spark, repo):
    patterns = spark.createDataFrame(
        [("https://host/data", "*.md"), ("https://host/other", "*")], "repo string, pattern string"
    )
    assert [r["path"] for r in tx.match_patterns(repo, patterns).collect()] == ["phoenix.md"]


def brute_match(path, pattern):
    if not any(c in pattern for c in "*?["):
        return path == pattern
    names, globs = path.split("/"), pattern.split("/")
    return len(names) == len(globs) and all(
        fnmatch.fnmatchcase(name, glob) and not (name.startswith(".") and glob[:1] in "*?[" and glob)
        if any(c in glob for c in "*?[") else name == glob
        for name, glob in zip(names, globs, strict=True)
    )


def test_patterns_against_trying_each_one(spark):
    rng = random.Random(5)
    names = ["a", "b", "ab", "b.md", "a.md", ".a", "a+b", "", "é.md", "x y"]
    globs = [*names, "*", "*.md", "?", "a*", "[ab]", "[!a]*", "?.md", "**", "[a-b]?", "*b*"]
    files = {(r, "/".join(rng.choices(names, k=rng.randint(1, 4)))) for r in ("r", "s") for _ in range(150)}
    patterns = {(rng.choice("rst"), "/".join(rng.choices(globs, k=rng.randint(1, 5)))) for _ in range(400)}
    got = tx.match_patterns(
        spark.createDataFrame([*files, (None, None)], "repo string, path string"),
        spark.createDataFrame([*patterns, *patterns, ("r", None)], "repo string, pattern string"),
    )
    want = sorted((r, p, g) for r, p in files for q, g in patterns if r == q and brute_match(p, g))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_steps_that_patterns_share_are_one(spark):
    patterns = spark.createDataFrame([("r", f"docs/*/{n}*.md") for n in range(50)], "repo string, pattern string")
    edges = tx.pattern_edges(patterns)
    assert sorted((r["level"], r["count"]) for r in edges.groupBy("level").count().collect()) == [(1, 1), (2, 1), (3, 50)]
    files = spark.createDataFrame([("r", "docs/a/1.md"), ("r", "docs/1.md")], "repo string, path string")
    assert [r["pattern"] for r in tx.match_patterns(files, patterns).collect()] == ["docs/*/1*.md"]
    assert tx.match_patterns(files, patterns.limit(0)).count() == 0


def test_collected_documents(parsed, repo):
    got = sorted(r["path"] for r in tx.collect_seed_documents(parsed, repo).collect())
    assert got == ["notes.txt", "phoenix.md"]


def test_diff_of_snapshots(spark):
    base = spark.createDataFrame(
        [("knowledge/a/qna.yaml", "1"), ("knowledge/b/qna.yaml", "1"), ("knowledge/c/qna.yaml", "1")],
        "path string, content string",
    )
    head = spark.createDataFrame(
        [("knowledge/a/qna.yaml", "1"), ("knowledge/b/qna.yaml", "2"), ("knowledge/d/qna.yaml", "1"),
         ("knowledge/d/qna.yml", "1"), ("docs/qna.yaml", "1")],
        "path string, content string",
    )
    got = {(r["path"].split("/")[1], r["state"]) for r in tx.taxonomy_diff(head, base).collect()}
    assert got == {("b", "modified"), ("d", "added")}
    assert tx.taxonomy_diff(head).count() == 3


def test_changed_files_once(spark):
    a = spark.createDataFrame([("x",), ("y",)], "path string")
    b = spark.createDataFrame([("y",), ("z",)], "path string")
    assert sorted(r[0] for r in tx.changed_files(a, b).collect()) == ["x", "y", "z"]
    diff = spark.createDataFrame([("x", "deleted"), (None, "modified"), ("z", "added")], "path string, state string")
    assert [r["path"] for r in tx.existing_not_deleted(diff).collect()] == ["z"]
    assert [r["path"] for r in tx.exclude_targets(a, b).collect()] == ["x"]


def test_levels(spark):
    df = spark.createDataFrame([("knowledge/textbook/puns-copy/general/qna.yaml",)], "path string")
    row = tx.taxonomy_levels(df).first()
    assert row["arrow_path"] == "knowledge->textbook->puns-copy->general"
    assert (row["leaf"], row["file_name"], len(row["levels"])) == ("general", "qna.yaml", 4)


def test_near_miss_names(spark):
    paths = ["knowledge/a/qna.yaml", "knowledge/a/qna.yml", "knowledge/a/QNA.YAML", "x/qna.yml", "knowledge/a/qna_invalid.yaml"]
    from seedmill.sources.taxonomy import taxonomy_files

    df = taxonomy_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {r["path"]: (r["is_seed_file"], r["warn_name"]) for r in df.collect()}
    assert [got[p] for p in paths] == [(True, False), (False, True), (False, True), (False, False), (False, False)]
    assert df.filter(F.col("warn_name")).count() == 2
