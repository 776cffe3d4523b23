"""Positions and running sums: the bucketed way equals the plain window, also with a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seedmill.functions.ordering import cut_at, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share key 0; the order has text and numbers in it."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 == 0, None).when(n % 5 == 0, 0).otherwise(n % 40).alias("k"),
        F.md5(n.cast("string")).alias("s"),
        (n * 7919 % 6007).alias("v"),
    )


SMALL = {"rows_per_bucket": 400}


@pytest.mark.parametrize("order", ["s", "v", "-v"])
def test_positions_in_buckets(skewed, order):
    column = -F.col("v") if order == "-v" else F.col(order)
    got = with_position(skewed, [column], keys=["k"], running={"total": F.col("v")}, **SMALL)
    window = Window.partitionBy("k").orderBy(column)
    want = skewed.select(
        "*",
        (F.row_number().over(window) - 1).cast("long").alias("position"),
        F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
    )
    assert got.count() == 6000
    assert got.exceptAll(want).isEmpty()
    assert want.exceptAll(got).isEmpty()


def test_global_positions(skewed):
    got = with_position(skewed, [F.col("k"), F.col("s")], **SMALL)
    assert [r["position"] for r in got.orderBy("position").collect()] == list(range(6000))
    inorder = [(r["k"] is not None, r["k"], r["s"]) for r in got.orderBy("position").collect()]
    assert inorder == sorted(inorder, key=lambda t: (t[0], t[1] or 0, t[2]))


def test_the_plan_does_not_grow_with_the_ranges(skewed):
    def size(rows_per_bucket):
        ranked = with_position(skewed, [F.col("s")], keys=["k"], rows_per_bucket=rows_per_bucket)
        return len(ranked._jdf.queryExecution().analyzed().toString())

    assert abs(size(600) - size(60)) < 100


def test_names_that_clash_are_an_error(skewed):
    with pytest.raises(ValueError, match="already"):
        with_position(skewed, [F.col("s")], position="k")


def test_an_empty_table_and_one_row(skewed):
    assert with_position(skewed.limit(0), [F.col("s")], keys=["k"]).count() == 0
    assert with_position(skewed.limit(1), [F.col("s")]).first()["position"] == 0


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_cut_labels_exactly(skewed, limits):
    before, none, every = cut_at(skewed, [F.col("s")], [1234, 0, 6000], **limits)
    counted = skewed.agg(F.count_if(before), F.count_if(none), F.count_if(every)).first()
    assert tuple(counted) == (1234, 0, 6000)
