"""Runs queries and their SQL twins side by side and reports differences.

    python -m testbed.compare [folder] [query ...]
"""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from testbed.queries import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cores="8", partitions="8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mendlist")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str):
    """(rows, problem or None)."""
    df = QUERIES[name](spark, folder)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        return len(got), None if got else "no rows"
    answer = con.execute(SQL[name])
    expected_columns, expected = rows_of([c[0] for c in answer.description], answer.fetchall())
    if columns != expected_columns:
        return len(got), f"columns {columns} != {expected_columns}"
    if len(got) != len(expected):
        return len(got), f"{len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return len(got), f"\n   got  {str(a)[:600]}\n   want {str(b)[:600]}"
    return len(got), None


def main(folder="/root/testdata/sf0.01", *names):
    spark, con, bad = local_session(), duck(folder), 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            n, problem = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in SQL else "rows only"
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {n:7} rows {time.time() - begin:6.2f}s {kind} {problem or ''}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
