"""The trip workload: one function per operation, each from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions.trips import angular_value
from fareline.session import local_table, small_table
from fareline.sources.trips import has_coordinates

# The inclusive tip range of the filtered modes.
TIP_RANGE = (1.0, 5.0)

# Fixed value: why an operation is skipped.
NO_COORDINATES = "source lacks coordinates"


def filter_tips(df: DataFrame, low: float = TIP_RANGE[0], high: float = TIP_RANGE[1]) -> DataFrame:
    return df.where(F.col("tip_amt").between(low, high))


def spread(column: str) -> list[Column]:
    return [
        F.avg(column).alias(f"{column}_mean"),
        F.stddev_samp(column).alias(f"{column}_std"),
    ]


def passenger_stats(df: DataFrame, key: str = "passenger_count") -> DataFrame:
    """Mean and sample deviation of fare and tip per key; rows without a key are left out."""
    known = df.where(F.col(key).isNotNull())
    return known.groupBy(key).agg(*spread("fare_amt"), *spread("tip_amt"))


# The lookup dimension is the grouped table under its flat names.
lookup_dimension = passenger_stats


def fare_value_counts(df: DataFrame) -> DataFrame:
    known = df.where(F.col("fare_amt").isNotNull())
    return known.groupBy("fare_amt").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class RowLookup:
    """Lookup keyed by ``row_id``; ``low`` and ``high`` bound the keys of a small one."""

    table: DataFrame
    low: int | None = None
    high: int | None = None


def row_lookup(lookup: DataFrame, key: str = "passenger_count") -> RowLookup:
    """Turn the lookup key into a ``row_id``; a fractional key matches no row.

    The lookup key takes the type of ``row_id``, never the other way round, and a lookup that is
    proven small is kept locally with the bounds of its keys.
    """
    measures = [name for name in lookup.columns if name != key]
    whole = F.col(key) == F.floor(key)
    keyed = lookup.where(whole).select(F.col(key).try_cast("bigint").alias("row_id"), *measures)
    keyed = keyed.where(F.col("row_id").isNotNull())
    rows = small_table(keyed)
    if rows is None:
        return RowLookup(keyed)
    bounds = pc.min_max(rows["row_id"])
    table = local_table(lookup.sparkSession, rows, keyed.schema)
    return RowLookup(table, bounds["min"].as_py(), bounds["max"].as_py())


def row_id_join(df: DataFrame, lookup: DataFrame | RowLookup) -> DataFrame:
    """Trips whose ``row_id`` equals a lookup key, with the lookup columns.

    The bounds of a small lookup reach the Parquet scan of the trips, so only row groups that can
    hold a matching ``row_id`` are read. Other lookups are joined by shuffle.
    """
    if isinstance(lookup, DataFrame):
        lookup = row_lookup(lookup)
    if lookup.low is not None:
        df = df.where(F.col("row_id").between(lookup.low, lookup.high))
    return df.join(lookup.table, "row_id")


def fare_plus_tip() -> Column:
    return F.col("fare_amt") + F.col("tip_amt")


def fare_times_tip() -> Column:
    return F.col("fare_amt") * F.col("tip_amt")


# Aggregate behind each operation that yields one number.
SCALAR_MEASURES: dict[str, Callable[[], Column]] = {
    "count": lambda: F.count("*"),
    "count_index": lambda: F.count("row_id"),
    "mean": lambda: F.avg("fare_amt"),
    "std": lambda: F.stddev_samp("fare_amt"),
    "mean_sum": lambda: F.avg(fare_plus_tip()),
    "mean_product": lambda: F.avg(fare_times_tip()),
    "mean_complex": lambda: F.avg(angular_value()),
}
# Expression behind each operation that yields one value per trip.
ROW_MEASURES: dict[str, Callable[[], Column]] = {
    "sum_columns": fare_plus_tip,
    "product_columns": fare_times_tip,
    "complex": angular_value,
}
# Operations that yield a table.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "value_counts": fare_value_counts,
    "groupby": passenger_stats,
}

# The operation names of the workload.
OPERATIONS = (
    "count",
    "count_index",
    "mean",
    "std",
    "mean_sum",
    "sum_columns",
    "mean_product",
    "product_columns",
    "value_counts",
    "mean_complex",
    "complex",
    "groupby",
    "join_count",
    "join",
)
COORDINATE_OPERATIONS = ("mean_complex", "complex")


def unavailable_reason(columns: list[str], name: str) -> str | None:
    """Why ``name`` cannot run on a table with ``columns``; ``None`` if it can."""
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation: {name}")
    lacking = name in COORDINATE_OPERATIONS and not has_coordinates(columns)
    return NO_COORDINATES if lacking else None


def operation(
    df: DataFrame, name: str, lookup: DataFrame | RowLookup | None = None
) -> DataFrame:
    """Plan of one operation. Nothing runs but the size check of the lookup in the two joins."""
    reason = unavailable_reason(df.columns, name)
    if reason:
        raise ValueError(f"{name}: {reason}")
    if name in SCALAR_MEASURES:
        return df.agg(SCALAR_MEASURES[name]().alias("value"))
    if name in ROW_MEASURES:
        return df.select("row_id", ROW_MEASURES[name]().alias("value"))
    if name in TABLES:
        return TABLES[name](df)
    if lookup is None:
        lookup = lookup_dimension(df)
    if name == "join":
        return row_id_join(df, lookup)
    return row_id_join(df.select("row_id"), lookup).agg(F.count("*").alias("value"))


def operation_availability(df: DataFrame) -> DataFrame:
    """One row per operation over ``df``: ``ok``, or ``skipped`` with the reason."""
    entries = []
    for name in OPERATIONS:
        reason = unavailable_reason(df.columns, name)
        entries.append(
            F.struct(
                F.lit(name).alias("operation"),
                F.lit("skipped" if reason else "ok").alias("status"),
                F.lit(reason or "").alias("reason"),
                F.col("input_rows"),
            )
        )
    counted = df.agg(F.count("*").alias("input_rows"))
    return counted.select(F.inline(F.array(*entries)))
