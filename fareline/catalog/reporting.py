"""Result-table queries over measurement records, with their JSON and CSV routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.catalog.registry import Query, rounded
from fareline.catalog.views import BACKENDS, MEASUREMENTS_SQL, measurements
from fareline.operators.reporting import (
    backend_medians,
    operation_by_backend,
    run_status,
    timing_statistics,
)
from fareline.session import new_path
from fareline.sources.records import load_results, write_csv, write_records

SECONDS = ("median_seconds", "min_seconds", "max_seconds")
# Fine enough that a mean of two recorded values is never cut at a half.
DIGITS = 9
# Records per written result document.
DOCUMENT_RECORDS = 500


def timings(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(timing_statistics(measurements(spark, folder)), SECONDS, DIGITS)


def timings_by_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same medians, with every group treated as too large for the built-in aggregate."""
    return rounded(timing_statistics(measurements(spark, folder), group_rows=0), SECONDS, DIGITS)


def pivoted(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(operation_by_backend(measurements(spark, folder)), BACKENDS, DIGITS)


def medians(spark: SparkSession, folder: str) -> DataFrame:
    table = backend_medians(timing_statistics(measurements(spark, folder)))
    return rounded(table, ["median_of_medians"], DIGITS)


def status(spark: SparkSession, folder: str) -> DataFrame:
    return run_status(measurements(spark, folder))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Run documents with a bounded number of records each, one per JSON line."""
    records = measurements(spark, folder).drop("source_file")
    number = F.floor(F.col("input_rows") / DOCUMENT_RECORDS).alias("number")
    record = F.struct(*records.columns)
    grouped = records.groupBy(number, "backend").agg(F.collect_list(record).alias("measurements"))
    metadata = F.struct(
        "backend",
        F.lit("events").alias("dataset"),
        F.size("measurements").cast("bigint").alias("rows"),
        F.lit("completed").alias("backend_status"),
    )
    return grouped.select(metadata.alias("metadata"), "measurements")


def document_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Timing statistics from result documents that were written as JSON and read back."""
    path = new_path(spark, "documents")
    write_records(documents(spark, folder), path)
    loaded = load_results(spark, path, multi_line=False)
    return rounded(timing_statistics(loaded.measurements), SECONDS, DIGITS)


def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """All measurement records through a CSV table; the warnings travel as text."""
    path = new_path(spark, "measurements")
    records = measurements(spark, folder)
    write_csv(records, path)
    kinds = ", ".join(
        f"{name} {'string' if name == 'warnings' else kind}" for name, kind in records.dtypes
    )
    loaded = spark.read.schema(kinds).option("header", True).csv(path)
    return loaded.withColumn("reason", F.coalesce("reason", F.lit("")))


GOOD_SQL = """good AS (
  SELECT * FROM measurements WHERE status = 'ok' AND operation <> 'read_construct'), timings AS (
  SELECT dataset, mode, operation, backend, median(seconds) AS median_seconds,
    min(seconds) AS min_seconds, max(seconds) AS max_seconds, count(seconds) AS repeats
  FROM good GROUP BY ALL)"""
TIMINGS_SQL = f"""WITH {MEASUREMENTS_SQL}, {GOOD_SQL}
SELECT dataset, mode, operation, backend, round(median_seconds, 9) AS median_seconds,
  round(min_seconds, 9) AS min_seconds, round(max_seconds, 9) AS max_seconds, repeats
FROM timings"""
PIVOT_SQL = ", ".join(
    f"round(max(median_seconds) FILTER (backend = '{name}'), 9) AS {name}" for name in BACKENDS
)

QUERIES = {
    "timing_statistics": Query(timings, TIMINGS_SQL),
    "timing_statistics_search": Query(timings_by_search, TIMINGS_SQL),
    "operation_by_backend": Query(
        pivoted,
        f"WITH {MEASUREMENTS_SQL}, {GOOD_SQL} SELECT dataset, mode, operation, {PIVOT_SQL} "
        "FROM timings GROUP BY ALL",
    ),
    "backend_medians": Query(
        medians,
        f"WITH {MEASUREMENTS_SQL}, {GOOD_SQL} SELECT backend, "
        "round(median(median_seconds), 9) AS median_of_medians FROM timings GROUP BY backend",
    ),
    "run_status": Query(
        status,
        f"""WITH {MEASUREMENTS_SQL} SELECT source_file, backend, dataset,
          CASE WHEN bool_or(status = 'error') THEN 'completed_with_errors' ELSE 'completed' END
            AS status, count(*) AS records
        FROM measurements GROUP BY source_file, backend, dataset""",
    ),
    "result_documents": Query(document_timings, TIMINGS_SQL),
    "csv_measurements": Query(csv_records, f"WITH {MEASUREMENTS_SQL} SELECT * FROM measurements"),
}
