"""Run registered queries next to their SQL and compare schema, row count and values.

    python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def difference(df, relation) -> tuple[str | None, int]:
    """What differs between a Spark result and a SQL result, or None, and the row count."""
    ours = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if ours != theirs:
        pairs = {n: (ours.get(n), theirs.get(n)) for n in {*ours, *theirs} if ours.get(n) != theirs.get(n)}
        return f"schema {pairs}", 0
    names = sorted(ours)
    left = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    right = sorted(map(repr, relation.project(", ".join(f'"{n}"' for n in names)).fetchall()))
    if len(left) != len(right):
        return f"rows {len(left)} against {len(right)}", len(left)
    wrong = [pair for pair in zip(left, right) if pair[0] != pair[1]]
    return (f"{len(wrong)} rows, first {wrong[0]}" if wrong else None), len(left)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    from lumenspan.registry import ORACLES, QUERIES

    print(f"without SQL: {sorted(set(QUERIES) - set(ORACLES))}")
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(args.sf)
    failed = []
    for name in args.names or ORACLES:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            problem, count = difference(df, connection.sql(ORACLES[name]))
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:900]}", 0
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''} {count} rows", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
