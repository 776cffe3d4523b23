"""Named queries over the given tables, each with the SQL that states its result."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seedmill.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists")

        @wraps(fn)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[key] = shipped
        if sql is not None:
            SQL[key] = sql.strip()
        return fn

    return register
