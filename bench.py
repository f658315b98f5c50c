"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_REPEATS (default 3, after one warm-up). Times are medians in seconds.

The workload runs over trips that were prepared as Parquet from the event table beforehand, as a
prepared sample would be. Uncached times contain the load of that file, the filter and the whole
result; filling the cache of the cached mode is reported on its own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fareline.catalog import all_queries  # noqa: E402
from fareline.catalog.views import trips  # noqa: E402
from fareline.operators.profile import materialise  # noqa: E402
from fareline.operators.workload import (  # noqa: E402
    OPERATIONS,
    SCALAR_MEASURES,
    filter_tips,
    lookup_dimension,
    operation,
    row_lookup,
)
from fareline.plans.workload import MODES, workload_results  # noqa: E402
from fareline.session import cached, new_path  # noqa: E402
from fareline.sources.samples import write_parquet  # noqa: E402
from fareline.sources.trips import load_trips  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

# The throughput table repeats the prepared trips this often, with jittered values.
COPIES = int(os.environ.get("BENCH_COPIES", "100"))
THROUGHPUT = (
    "count",
    "mean",
    "std",
    "sum_columns",
    "product_columns",
    "mean_complex",
    "complex",
    "groupby",
    "value_counts",
    "join_count",
)

# Registered queries timed besides the workload, each over its whole tables.
QUERIES = (
    "passenger_stats_wide",
    "fare_value_counts_wide",
    "filter_tips_wide",
    "filter_retention",
    "priority_sample",
    "dense_row_id",
    "time_ordered",
    "chronological_split",
    "expanding_folds",
    "tolerant_diff",
    "timing_statistics",
    "operation_by_backend",
    "impute_scale",
    "encode_zones",
    "macro_metrics",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("fareline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fareline-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(work: Callable[[], object]) -> float:
    times = []
    for _ in range(REPEATS + 1):
        started = time.perf_counter()
        work()
        times.append(time.perf_counter() - started)
    return statistics.median(times[1:])


SCALARS = {*SCALAR_MEASURES, "join_count"}


def finish(result: DataFrame, name: str) -> None:
    """Scalars come back, tables are computed in full without being sent to the driver."""
    if name in SCALARS:
        result.collect()
    else:
        materialise(result)


def workload_times(spark: SparkSession, path: str) -> dict[str, float]:
    times = {}
    schema = load_trips(spark, path).schema

    def load() -> DataFrame:
        return load_trips(spark, path, schema=schema)

    # The JVM compiles its hot paths during the first queries of a session.
    for mode in MODES * 2:
        workload_results(load(), mode).collect()
    times["standard/read_collect"] = timed(lambda: materialise(load()))
    inputs = {"standard": load, "filtered": lambda: filter_tips(load())}
    for mode in MODES:
        if mode == "filtered_cached":
            started = time.perf_counter()
            with cached(filter_tips(load())) as kept:
                times["filtered_cached/setup"] = time.perf_counter() - started
                times |= mode_times(mode, lambda kept=kept: kept)
        else:
            times |= mode_times(mode, inputs[mode])
        times[f"{mode}/all_operations"] = timed(
            lambda mode=mode: workload_results(load(), mode).collect()
        )
    return times


def mode_times(mode: str, frame: Callable[[], DataFrame]) -> dict[str, float]:
    # Like the input, the lookup of a mode is set up before its operations are timed.
    lookup = row_lookup(lookup_dimension(frame()))
    return {
        f"{mode}/{name}": timed(lambda name=name: finish(operation(frame(), name, lookup), name))
        for name in OPERATIONS
    }


def throughput(spark: SparkSession, path: str) -> dict[str, float]:
    """Million rows per second of operations over many copies of the trips, written first."""
    large = new_path(spark, "large")
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    rows = spark.read.parquet(path).select("*", copies)
    jitter = 1 + F.col("copy") / 10_000
    rows = rows.withColumns(
        {
            "row_id": F.col("row_id") * COPIES + F.col("copy"),
            "fare_amt": F.col("fare_amt") * jitter,
            "tip_amt": F.col("tip_amt") * jitter,
        }
    ).drop("copy")
    write_parquet(rows, large)
    schema = load_trips(spark, large).schema
    count = load_trips(spark, large, schema=schema).count()
    found = {}
    for name in THROUGHPUT:
        frame = load_trips(spark, large, schema=schema)
        lookup = row_lookup(lookup_dimension(frame)) if name == "join_count" else None
        started = time.perf_counter()
        finish(operation(frame, name, lookup), name)
        found[name] = round(count / (time.perf_counter() - started) / 1e6, 2)
    return found | {"million_rows": round(count / 1e6, 3)}


def main() -> None:
    spark = session()
    path = new_path(spark, "trips")
    write_parquet(trips(spark, FOLDER), path)
    times = workload_times(spark, path)
    registered = all_queries()
    for name in QUERIES:
        query = registered[name]
        times[name] = timed(lambda query=query: materialise(query.run(spark, FOLDER)))
    rounded = {name: round(seconds, 4) for name, seconds in times.items()}
    summary = {
        "metric": "total of median seconds over the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": rounded,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "repeats": REPEATS,
        "workload_rows": spark.read.parquet(path).count(),
        "million_rows_per_second": throughput(spark, path),
    }
    print(json.dumps(summary))
    spark.stop()


if __name__ == "__main__":
    main()
