"""Result tables from measurement records and result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.operators.order_stats import GROUP_ROWS, grouped_median
from fareline.session import settled
from fareline.sources.records import Results, write_csv

TIMING_KEYS = ("dataset", "mode", "operation", "backend")
PIVOT_KEYS = TIMING_KEYS[:3]

# A lazily constructed plan is no measurement of a read.
EXCLUDED_OPERATION = "read_construct"


def comparable_measurements(measurements: DataFrame) -> DataFrame:
    """Successful records whose time means finished work."""
    finished = F.col("status") == "ok"
    return measurements.where(finished & (F.col("operation") != EXCLUDED_OPERATION))


def timing_statistics(measurements: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Median, smallest, largest and number of times per dataset, mode, operation and backend."""
    return grouped_median(
        comparable_measurements(measurements),
        TIMING_KEYS,
        "seconds",
        "median_seconds",
        [
            F.min("seconds").alias("min_seconds"),
            F.max("seconds").alias("max_seconds"),
            F.count("seconds").alias("repeats"),
        ],
        group_rows,
    )


def operation_by_backend(
    measurements: DataFrame,
    backends: Sequence[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Median seconds with one column per backend; a combination without records stays NULL.

    The pivot works on the small table of medians, which names the backends as well. A list of
    backends orders the columns and may name some without records; it is an error if it leaves out a
    backend that has any.
    """
    medians = settled(timing_statistics(measurements, group_rows), "medians")
    found = medians.select("backend").distinct().orderBy("backend")
    present = [row["backend"] for row in found.collect()]
    names = present if backends is None else list(backends)
    absent = [name for name in present if name not in names]
    if absent:
        raise ValueError(f"the list of backends leaves out {absent}")
    pivoted = medians.groupBy(*PIVOT_KEYS).pivot("backend", names)
    return pivoted.agg(F.first("median_seconds"))


def backend_medians(timings: DataFrame) -> DataFrame:
    """Median of the operation medians per backend, fastest first."""
    medians = grouped_median(timings, ["backend"], "median_seconds", "median_of_medians")
    return medians.orderBy("median_of_medians", "backend")


def run_status(measurements: DataFrame, run: str = "source_file") -> DataFrame:
    """One row per run: its backend, dataset and whether any of its records failed."""
    failed = F.bool_or(F.col("status") == "error")
    status = F.when(failed, "completed_with_errors").otherwise("completed")
    return measurements.groupBy(run, "backend", "dataset").agg(
        status.alias("status"), F.count("*").alias("records")
    )


def recorded_status(runs: DataFrame) -> DataFrame:
    """Status table as stated by the run documents themselves."""
    return runs.select(
        F.col("source_file").alias("file"),
        F.col("metadata.backend").alias("backend"),
        F.col("metadata.backend_status").alias("status"),
        F.col("metadata.dataset").alias("dataset"),
        F.coalesce("metadata.reason", F.lit("")).alias("reason"),
    )


def model_scores(models: DataFrame) -> DataFrame:
    return models.select(
        F.col("source_file").alias("file"),
        "dataset",
        "stage",
        F.col("regression.rmse").alias("rmse"),
        F.col("regression.mae").alias("mae"),
        F.col("classification.macro_f1").alias("macro_f1"),
    )


def report_tables(results: Results) -> dict[str, DataFrame]:
    """All result tables by name. Documents without measurements or models make empty tables."""
    timings = timing_statistics(results.measurements)
    return {
        "timings": timings,
        "operation_by_backend": operation_by_backend(results.measurements),
        "backend_medians": backend_medians(timings),
        "run_status": recorded_status(results.runs),
        "model_scores": model_scores(results.models),
    }


def write_reports(results: Results, path: str) -> list[str]:
    """Write every result table as CSV below ``path``; returns the folders."""
    folders = []
    for name, table in report_tables(results).items():
        write_csv(table, f"{path}/{name}")
        folders.append(f"{path}/{name}")
    return folders
