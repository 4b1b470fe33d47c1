"""Run registered queries and compare each with its SQL: ``python check.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np

from turnwise.catalog import ORACLES, QUERIES
from turnwise.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(value)
    if hasattr(value, "item"):
        return value.item()
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def compare(df, connection, sql):
    """None where both results agree, else a short description."""
    ours = [tuple(r) for r in df.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    left, right = rows_of(df.columns, ours), rows_of(names, theirs)
    if left == right:
        return None
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return f"rows {len(left)} / {len(right)}\n    spark  {only_left}\n    duckdb {only_right}"


def main() -> int:
    arguments = sys.argv[1:]
    folder = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in arguments or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = (
                compare(df, connection, ORACLES[name]) if name in ORACLES
                else (None if df.collect() else "no rows")
            )
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {problem or ''}"[:1500], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
