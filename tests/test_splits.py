"""Splits, shuffles, batches and packs: exact sizes, nothing lost, nothing over its limit."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedmill.operators import splits as sp



def numbers(spark, n):
    return spark.range(n).select((F.lit(n) - F.col("id")).alias("n"))


def by(name="n"):
    return [F.col(name)]


def sides(df):
    return {
        name: sorted(r["n"] for r in df.filter(F.col("split") == name).collect())
        for name in ("train", "valid", "test")
    }


@pytest.mark.parametrize("n", [0, 1, 9, 10, 37])
def test_80_20(spark, n):
    got = sides(sp.split_80_20(numbers(spark, n), by()))
    every, cut = list(range(1, n + 1)), n * 8 // 10
    assert got == {"train": every[:cut], "valid": every[cut:], "test": []}


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("n", [9, 10, 37])
def test_70_20(spark, n, compat):
    got = sides(sp.split_70_20(numbers(spark, n), by(), compat))
    every, a = list(range(1, n + 1)), n // 10 * 7
    b = a + n // 10 * 2
    assert got["train"] == every[:a] and got["valid"] == every[a:b]
    assert got["test"] == (every[:b] if compat else every[b:])


def test_labels_need_no_shuffle_of_the_rows(spark):
    df = numbers(spark, 50).withColumn("wide", F.lit("x"))
    plan = sp.split_80_20(df, by())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty_split_is_an_error(spark):
    df = sp.split_70_20(numbers(spark, 30), by())
    assert sp.require_nonempty_splits(df) is df
    with pytest.raises(ValueError, match="the test split has no rows"):
        sp.require_nonempty_splits(df.filter("split <> 'test'"))


def test_shuffle_is_a_fixed_permutation(spark):
    df = numbers(spark, 60)

    def order(seed):
        return [r["n"] for r in sp.shuffle(df, seed, "n").orderBy("position").collect()]

    assert sorted(order(1)) == list(range(1, 61))
    assert order(1) == order(1) and order(1) != order(2)


def test_incomplete_batch_is_not_formed(spark):
    got = sp.batches(numbers(spark, 23), 5, by())
    assert got.count() == 20
    assert [r["count"] for r in got.groupBy("batch").count().collect()] == [5] * 4
    assert sorted(r["n"] for r in got.filter("batch = 1").collect()) == [6, 7, 8, 9, 10]


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5])], "batch int, tokens array<int>")
    got = {tuple(r["tokens"]): (r["length"], r["inputs"], r["targets"]) for r in sp.pad_batch(df).collect()}
    assert got == {(1, 2, 3): (3, [1, 2], [2, 3]), (4,): (1, [4, 0], [0, 0]), (5,): (1, [], [])}


def test_long_rows(spark):
    df = spark.createDataFrame([(0, 10), (0, 3000), (1, 2048)], "batch int, n int")
    assert sorted(r["n"] for r in sp.drop_long(df, F.col("n"), 2048).collect()) == [10, 2048]
    warned = {r["batch"]: (r["longest"], r["long_rows"], r["warn"]) for r in sp.warn_long(df, F.col("n")).collect()}
    assert warned == {0: (3000, 1, True), 1: (2048, 0, False)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lengths=st.lists(st.integers(0, 100), min_size=1, max_size=80))
def test_packs_stay_under_the_limit(spark, lengths):
    df = spark.createDataFrame(list(enumerate(lengths)), "id int, n int")
    packed = sp.pack_sequences(df, "n", 100, by("id"))
    rows = packed.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(lengths)))
    packs = {}
    for r in rows:
        packs.setdefault((r["fit"], r["pack"]), []).append(r["n"])
    assert all(sum(p) <= 100 for p in packs.values())
    for fit in {k[0] for k in packs}:
        full = [p for k, p in packs.items() if k[0] == fit]
        assert sum(len(p) < fit for p in full) <= 1
    stats = sp.packing_stats(packed, "n").first()
    assert stats["num_batches"] == len(packs) and stats["longest_batch"] == max(map(sum, packs.values()))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50), max_size=30))
def test_patterns_use_every_sample_once(histogram):
    used, packs = {}, 0
    for pattern, uses in sp.pack_patterns(histogram, 60):
        assert uses > 0 and sum(n * length for length, n in pattern.items()) <= 60
        packs += uses
        for length, n in pattern.items():
            used[length] = used.get(length, 0) + n * uses
    assert used == {length: count for length, count in histogram.items() if count}
    total = sum(length * count for length, count in histogram.items())
    assert packs <= 2 * total / 60 + 1


def test_packs_by_patterns(spark):
    lengths = [(7 * k) % 101 for k in range(3000)] + [51] * 1500 + [0] * 20
    df = spark.createDataFrame(list(enumerate(lengths)), "id int, n int").repartition(5)
    rows = sp.pack_by_patterns(df, "n", 100, by("id")).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(lengths)))
    packs = {}
    for r in rows:
        packs.setdefault(r["pack"], []).append(max(1, r["n"]))
    assert sorted(packs) == list(range(len(packs)))
    assert max(map(sum, packs.values())) <= 100
    # No two samples over half the limit share a pack, so there can be hardly fewer.
    assert len(packs) <= 1.01 * sum(n > 50 for n in lengths)
    assert sp.pack_by_patterns(df.limit(0), "n", 100, by("id")).count() == 0
    for wrong in (101, None):
        bad = spark.createDataFrame([(1, wrong)], "id int, n int")
        with pytest.raises(Exception, match="longer than the pack"):
            sp.pack_by_patterns(bad, "n", 100, by("id")).collect()


def test_sample_over_the_pack_limit_is_an_error(spark):
    df = spark.createDataFrame([(1, 101)], "id int, n int")
    with pytest.raises(Exception, match="longer than the pack"):
        sp.pack_sequences(df, "n", 100, by("id")).collect()


def test_first_tasks(spark):
    assert [r["n"] for r in sp.take_first_n(numbers(spark, 9), by()).collect()] == [1, 2, 3, 4]
