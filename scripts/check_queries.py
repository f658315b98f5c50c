"""Run registered queries on Spark and their SQL on DuckDB, and compare the results.

usage: check_queries.py [--sf 0.01] [--skip-unchecked] [query ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from fareline.catalog import all_queries  # noqa: E402


def make_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fareline-check")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype({c: object for c in frame.columns if frame[c].dtype == "string"})
    return frame.sort_values(list(frame.columns), ignore_index=True, key=lambda c: c.astype(str))


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """``None`` if both hold the same rows, names and types."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    actual, expected = normal(actual), normal(expected)
    for name in actual.columns:
        a, b = actual[name], expected[name]
        kinds = (a.dtype.kind, b.dtype.kind, a.dtype.itemsize, b.dtype.itemsize)
        if kinds[0] != kinds[1] or (kinds[0] != "M" and kinds[2] != kinds[3]):
            return f"{name}: type {a.dtype} != {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same.idxmin()
            return f"{name}: {(~same).sum()} values differ, first {a[at]!r} != {b[at]!r}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--skip-unchecked", action="store_true")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark, connection = make_session(), connect(folder)
    failed = []
    for name, query in all_queries().items():
        if options.names and name not in options.names:
            continue
        if options.skip_unchecked and query.sql is None:
            continue
        started = time.perf_counter()
        try:
            actual = query.run(spark, folder).toPandas()
            seconds = time.perf_counter() - started
            if query.sql is None:
                problem, note = None, "rows only"
            else:
                problem = difference(actual, connection.execute(query.sql).df())
                note = "equal"
        except Exception as error:  # report and go on with the next query
            seconds, problem = time.perf_counter() - started, f"{type(error).__name__}: {error}"
            problem = problem[:1500]
        if problem:
            failed.append(name)
        rows = "" if problem else len(actual)
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {seconds:7.2f}s {rows} {problem or note}")
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
