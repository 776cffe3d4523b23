"""Run a query in Spark and its SQL in DuckDB, and compare the rows without regard to order.

As a script: ``python tests/compare.py [folder] [query ...]``.
"""

import math
import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, fn, sql: str, folder: str, connection) -> tuple[int, str | None]:
    frame = fn(spark, folder)
    left = normal(frame.columns, frame.collect())
    result = connection.sql(sql)
    right = normal(result.columns, result.fetchall())
    if left[0] != right[0]:
        return len(left[1]), f"columns {left[0]} and {right[0]}"
    if len(left[1]) != len(right[1]):
        return len(left[1]), f"{len(left[1])} and {len(right[1])} rows"
    for a, b in zip(left[1], right[1], strict=True):
        if a != b:
            return len(left[1]), f"\n  spark  {str(a)[:600]}\n  duckdb {str(b)[:600]}"
    return len(left[1]), None


def main() -> int:
    import __spark_entry__ as entry

    from seedmill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracle:
                rows, problem = differences(spark, queries[name], oracle[name], folder, connection)
            else:
                rows, problem = queries[name](spark, folder).count(), None
        except Exception as error:
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {rows:8} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} queries agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
