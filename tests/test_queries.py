"""Every registered query against the SQL that states its result, on whole tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

from seedmill.plans.registry import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    count, problem = differences(spark, entry.queries()[name], SQL[name], FOLDER, duck)
    assert problem is None
    assert count > 0


def test_entry_ranks_all_classes(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["qna_file", "change", "delta", "rank"]
    assert frame.count() == 20


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
