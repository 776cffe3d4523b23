"""Versions of an index: readers during a rebuild, writers at once, failures, retention."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seedmill.sources import snapshots


def rows(spark, *ids, text="x"):
    return spark.createDataFrame([(i, text, n) for n, i in enumerate(ids)], "id string, content string, n int")


def ids(df):
    return sorted(r["id"] or "" for r in df.select("id").collect())


def test_a_reader_keeps_its_version_while_the_index_is_rebuilt(spark, tmp_path):
    uri = str(tmp_path / "index")
    assert snapshots.versions(spark, uri) == []
    with pytest.raises(FileNotFoundError):
        snapshots.read_version(spark, uri)
    assert snapshots.rebuild(rows(spark, "a", "b").drop("n"), uri) == 1
    reader = snapshots.read_version(spark, uri)
    assert snapshots.rebuild(rows(spark, "c", text="new").drop("n"), uri) == 2
    assert snapshots.append(rows(spark, "d", "c", "d"), uri, "n") == 3
    assert ids(reader) == ["a", "b"] and ids(snapshots.read_version(spark, uri)) == ["c", "d"]
    assert ids(snapshots.read_version(spark, uri, 2)) == ["c"]
    assert snapshots.read_version(spark, uri).filter("id = 'c'").first()["content"] == "new"


def test_a_failed_write_leaves_the_newest_version(spark, tmp_path):
    uri = str(tmp_path / "index")
    snapshots.rebuild(rows(spark, "a").drop("n"), uri)
    broken = rows(spark, "b").withColumn("id", F.raise_error(F.lit("no")).cast("string"))
    for write in (lambda: snapshots.rebuild(broken, uri), lambda: snapshots.append(broken, uri, "n")):
        with pytest.raises(PySparkException):
            write()
    assert snapshots.versions(spark, uri) == [1] and ids(snapshots.read_version(spark, uri)) == ["a"]


def test_a_version_has_one_winner(spark, tmp_path):
    uri = str(tmp_path / "index")
    snapshots.rebuild(rows(spark, "a").drop("n"), uri)
    before = snapshots.folders_of(spark, uri, 1)
    assert not snapshots.commit(spark, uri, ["other"], 1)
    assert snapshots.folders_of(spark, uri, 1) == before
    assert not [name for name in os.listdir(uri) if name.startswith("_staged")]


def test_a_rename_that_comes_second_is_undone(spark, tmp_path, monkeypatch):
    """Both writers found the number free; the file system decides."""
    uri = str(tmp_path / "index")
    snapshots.rebuild(rows(spark, "a").drop("n"), uri)
    before, real = snapshots.folders_of(spark, uri, 1), snapshots._files

    class Blind:
        def __init__(self, files):
            self.files = files

        def exists(self, path):
            return False if path.getName() == "1" else self.files.exists(path)

        def __getattr__(self, name):
            return getattr(self.files, name)

    monkeypatch.setattr(snapshots, "_files", lambda s, u: (real(s, u)[0], Blind(real(s, u)[1])))
    assert not snapshots.commit(spark, uri, ["other"], 1)
    monkeypatch.undo()
    assert snapshots.folders_of(spark, uri, 1) == before and ids(snapshots.read_version(spark, uri)) == ["a"]
    assert [name for name in os.listdir(f"{uri}/versions/1") if name.startswith("_staged")] == []


def test_appends_at_once_keep_every_id_once(spark, tmp_path):
    uri = str(tmp_path / "index")
    with ThreadPoolExecutor(3) as pool:
        parts = [("a", "b", "c"), ("b", "c", "d"), ("c", "d", "e")]
        done = list(pool.map(lambda part: snapshots.append(rows(spark, *part), uri, "n"), parts))
    assert sorted(done) == [1, 2, 3] == snapshots.versions(spark, uri)
    assert ids(snapshots.read_version(spark, uri)) == ["a", "b", "c", "d", "e"]


def test_an_append_that_a_rebuild_overtook_puts_back_what_it_left_out(spark, tmp_path, monkeypatch):
    uri = str(tmp_path / "index")
    snapshots.rebuild(rows(spark, "a", "b").drop("n"), uri)
    real, calls = snapshots.commit, []

    def overtaken(*args):
        if not calls:
            calls.append(1)
            snapshots.rebuild(rows(spark, "z").drop("n"), uri)
        return real(*args)

    monkeypatch.setattr(snapshots, "commit", overtaken)
    assert snapshots.append(rows(spark, "a", "c"), uri, "n") == 3
    assert ids(snapshots.read_version(spark, uri)) == ["a", "c", "z"]


def test_old_versions_go_with_the_data_only_they_had(spark, tmp_path):
    uri = str(tmp_path / "index")
    snapshots.rebuild(rows(spark, "gone").drop("n"), uri)
    snapshots.rebuild(rows(spark, "a").drop("n"), uri)
    snapshots.append(rows(spark, "b"), uri, "n")
    snapshots.append(rows(spark, None, "b", None), uri, "n")
    assert snapshots.forget(spark, uri, 2) == [1, 2]
    assert ids(snapshots.read_version(spark, uri)) == ["", "a", "b"] and ids(snapshots.read_version(spark, uri, 3)) == ["a", "b"]
    assert len(os.listdir(f"{uri}/data")) == 3
    with pytest.raises(ValueError):
        snapshots.forget(spark, uri, 0)


def test_empty_rows_are_a_version(spark, tmp_path):
    uri = str(tmp_path / "index")
    assert snapshots.rebuild(rows(spark, "a").drop("n").limit(0), uri) == 1
    assert snapshots.append(rows(spark, "a"), uri, "n") == 2
    assert ids(snapshots.read_version(spark, uri)) == ["a"]
