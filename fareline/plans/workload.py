"""The workload over its three inputs: standard, filtered, and filtered with caching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.operators import workload as w
from fareline.session import cached, settled
from fareline.sources.trips import COORDINATES

# The input modes of the workload.
MODES = ("standard", "filtered", "filtered_cached")

DIGEST_SCHEMA = "mode string, operation string, rows bigint, value double"


@contextmanager
def mode_input(df: DataFrame, mode: str) -> Iterator[DataFrame]:
    """Input of a mode. The cached input is filled on entry and released on exit."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "standard":
        yield df
    elif mode == "filtered":
        yield w.filter_tips(df)
    else:
        with cached(w.filter_tips(df)) as kept:
            yield kept


def run_workload(df: DataFrame, names: Iterable[str] = w.OPERATIONS) -> dict[str, DataFrame]:
    """Plans of the named operations over one input; unavailable ones are left out.

    The lookup is built from the same input, so a filtered mode gets the filtered lookup.
    """
    runnable = [name for name in names if w.unavailable_reason(df.columns, name) is None]
    lookup = None
    if {"join", "join_count"} & set(runnable):
        lookup = w.row_lookup(w.lookup_dimension(df))
    return {name: w.operation(df, name, lookup) for name in runnable}


#: Values that the measures of one number are made of, and the measures made of each.
VALUES = {
    "fare": lambda: F.col("fare_amt"),
    "total": w.fare_plus_tip,
    "product": w.fare_times_tip,
    "angle": w.angular_value,
}
MEANS = {
    "mean": "fare",
    "mean_sum": "total",
    "sum_columns": "total",
    "mean_product": "product",
    "product_columns": "product",
    "mean_complex": "angle",
    "complex": "angle",
}


def fused_pass(df: DataFrame) -> DataFrame:
    """Everything the workload needs of its input but the rows of the join, from one scan.

    Grouping sets give a row for each passenger count, with sums, counts and spreads, and a row for
    each fare. Whole-table measures are merged from the rows of the passenger counts, so they need
    no set of their own.
    """
    lacking = w.unavailable_reason(df.columns, "complex")
    values = {name: make() for name, make in VALUES.items() if not (lacking and name == "angle")}
    sums = [F.count(v).alias(f"{name}_n") for name, v in values.items()]
    sums += [F.sum(v).alias(f"{name}_sum") for name, v in values.items()]
    keys = ("passenger_count", "fare_amt")
    grouped = df.groupingSets([[F.col(key)] for key in keys], *keys)
    return grouped.agg(
        F.grouping("passenger_count").alias("of_fare"),
        F.count("*").alias("rows"),
        F.count("row_id").alias("ids"),
        *sums,
        *w.spread("fare_amt"),
        *w.spread("tip_amt"),
    )


def scalar_digest(groups: DataFrame, columns: list[str]) -> DataFrame:
    """The one-number and row-wise operations, merged from the rows of the passenger counts.

    A row-wise operation is represented by its row count and the mean of its values.
    """
    merged = {name: F.sum(name).alias(name) for name in groups.columns if name.endswith(("_n", "_sum"))}
    totals = groups.agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), *merged.values())
    known = totals.select("fare_n", "fare_sum").first()
    # Squared distances from the mean of all: those within the groups, and those of their means.
    mean = F.lit(known["fare_sum"] / known["fare_n"] if known["fare_n"] else None).cast("double")
    inside = F.coalesce(F.pow("fare_amt_std", 2) * (F.col("fare_n") - 1), F.lit(0.0))
    between = F.col("fare_n") * F.pow(F.col("fare_amt_mean") - mean, 2)
    squares = F.sum(F.when(F.col("fare_n") > 0, inside + between)).alias("squares")
    totals = groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"),
        squares,
        *merged.values(),
    )
    value = {name: F.try_divide(F.col(f"{of}_sum"), F.col(f"{of}_n")) for name, of in MEANS.items()}
    value |= {"count": F.col("rows"), "count_index": F.col("ids")}
    value["std"] = F.when(F.col("fare_n") > 1, F.sqrt(F.col("squares") / (F.col("fare_n") - 1)))
    one_row = F.lit(1).cast("bigint")
    entries = [
        F.struct(
            F.lit(name).alias("operation"),
            (F.col("rows") if name in w.ROW_MEASURES else one_row).alias("rows"),
            value[name].cast("double").alias("value"),
        )
        for name in w.OPERATIONS
        if name in value and w.unavailable_reason(columns, name) is None
    ]
    return totals.select(F.inline(F.array(*entries)))


def table_digest(result: DataFrame, name: str, value: str) -> DataFrame:
    return result.agg(
        F.lit(name).alias("operation"),
        F.count("*").alias("rows"),
        F.avg(value).alias("value"),
    )


def workload_digest(df: DataFrame, mode: str) -> DataFrame:
    """Every available operation of a mode as one row: operation, result rows, mean result value.

    The input is read once for all groups and sums, and once more for the row numbers that the
    lookup's keys can match, which prune its row groups.
    """
    table = settled(fused_pass(df), "workload")
    groups = table.where("of_fare = 0").drop("fare_amt")
    fares = table.where("of_fare = 1 AND fare_amt IS NOT NULL")
    measures = [f"{name}_{kind}" for name in ("fare_amt", "tip_amt") for kind in ("mean", "std")]
    lookup = groups.where("passenger_count IS NOT NULL").select("passenger_count", *measures)
    parts = [
        scalar_digest(groups, df.columns),
        table_digest(fares, "value_counts", "rows"),
        table_digest(lookup, "groupby", "fare_amt_mean"),
    ]
    joined = w.row_id_join(df.select("row_id"), lookup).agg(
        F.count("*").alias("_rows"), F.avg("fare_amt_mean").alias("_value")
    )
    entries = [("join", "_rows", "_value"), ("join_count", "_one", "_count")]
    joined = joined.select(
        "*", F.lit(1).cast("bigint").alias("_one"), F.col("_rows").cast("double").alias("_count")
    )
    rows = [
        F.struct(F.lit(n).alias("operation"), F.col(r).alias("rows"), F.col(v).alias("value"))
        for n, r, v in entries
    ]
    parts.append(joined.select(F.inline(F.array(*rows))))
    digest = parts[0]
    for part in parts[1:]:
        digest = digest.unionByName(part)
    return digest.select(F.lit(mode).alias("mode"), "operation", "rows", "value")


def workload_results(df: DataFrame, mode: str) -> DataFrame:
    """Digest of a mode, computed. The cached mode holds the columns that its operations read; the
    pass over all groups fills the cache, which is released before returning."""
    if mode != "filtered_cached":
        with mode_input(df, mode) as frame:
            return workload_digest(frame, mode)
    read = ["row_id", "fare_amt", "tip_amt", "passenger_count"]
    read += [name for name in COORDINATES if name in df.columns]
    kept = w.filter_tips(df).select(*read).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # At most one row per operation comes back.
        rows = workload_digest(kept, mode).collect()
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame(rows, DIGEST_SCHEMA)
