"""Workload queries: the single operations, and all of them in the three input modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fareline.catalog.registry import Query, rounded, value
from fareline.catalog.trips import ANGULAR_SQL, COORDINATE_COLUMNS, TRIP_COLUMNS
from fareline.catalog.views import TRIPS_SQL, WIDE_SQL, trips, trips_wide
from fareline.operators.workload import (
    fare_value_counts,
    filter_tips,
    lookup_dimension,
    operation,
    passenger_stats,
)
from fareline.plans.pandas_surface import grouped_frame, indexed, pandas_filter, pandas_operation
from fareline.plans.workload import workload_results
from fareline.session import written

SPREAD = ("fare_amt_mean", "fare_amt_std", "tip_amt_mean", "tip_amt_std")


def whole(name: str):
    """Operation whose value is a number of rows."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operation(trips(spark, folder), name)

    return run


def scalar(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operation(trips(spark, folder), name).select(value())

    return run


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return operation(trips(spark, folder), "value_counts")


def value_counts_wide(spark: SparkSession, folder: str) -> DataFrame:
    return fare_value_counts(filter_tips(trips_wide(spark, folder)))


def stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(operation(trips(spark, folder), "groupby"), SPREAD)


def stats_wide(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(passenger_stats(filter_tips(trips_wide(spark, folder))), SPREAD)


def lookup(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(lookup_dimension(filter_tips(trips(spark, folder))), SPREAD)


def row_id_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = operation(trips(spark, folder), "join")
    return rounded(rounded(joined, SPREAD), COORDINATE_COLUMNS, 9)


def mode(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(workload_results(trips(spark, folder), name), ["value"])

    return run


def pandas_surface(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped statistics of the filtered trips through the pandas API on Spark."""
    kept = filter_tips(trips(spark, folder))
    return rounded(grouped_frame(kept), SPREAD)


def pandas_values(spark: SparkSession, folder: str) -> DataFrame:
    # Written first: the surface repeats each column in its missing-value checks, and the view
    # would parse JSON every time.
    plain = trips(spark, folder).select("row_id", "fare_amt", "tip_amt")
    frame = pandas_filter(indexed(written(plain, "trips")))
    series = pandas_operation(frame, "product_columns").rename("value")
    return series.to_frame().to_spark(index_col="row_id").select("row_id", value())


AGGREGATES = {
    "mean": "avg(fare_amt)",
    "std": "stddev_samp(fare_amt)",
    "mean_sum": "avg(fare_amt + tip_amt)",
    "mean_product": "avg(fare_amt * tip_amt)",
    "mean_complex": "avg(angle)",
}


def scalar_sql(name: str) -> str:
    return (
        f"WITH {TRIPS_SQL}, {ANGULAR_SQL} "
        f"SELECT round({AGGREGATES[name]}, 6) AS value FROM valued"
    )


def spread_sql(source: str, digits: int | None = 6) -> str:
    measures = [
        (f"{measure}({column})", f"{column}_{name}")
        for column in ("fare_amt", "tip_amt")
        for measure, name in (("avg", "mean"), ("stddev_samp", "std"))
    ]
    if digits is not None:
        measures = [(f"round({text}, {digits})", name) for text, name in measures]
    columns = ", ".join(f"{text} AS {name}" for text, name in measures)
    return (
        f"SELECT passenger_count, {columns} FROM {source} "
        "WHERE passenger_count IS NOT NULL GROUP BY passenger_count"
    )


def join_sql(columns: str) -> str:
    return f"""WITH {TRIPS_SQL}, lookup AS ({spread_sql("trips", None)})
        SELECT {columns} FROM trips JOIN lookup
        ON lookup.passenger_count = floor(lookup.passenger_count)
          AND trips.row_id = CAST(lookup.passenger_count AS BIGINT)"""


def mode_sql(name: str) -> str:
    where = "" if name == "standard" else "WHERE tip_amt BETWEEN 1 AND 5"
    fused = {
        "count": ("1", "count(*)"),
        "count_index": ("1", "count(row_id)"),
        **{key: ("1", text) for key, text in AGGREGATES.items()},
        "sum_columns": ("count(*)", "avg(fare_amt + tip_amt)"),
        "product_columns": ("count(*)", "avg(fare_amt * tip_amt)"),
        "complex": ("count(*)", "avg(angle)"),
    }
    parts = [
        f"SELECT '{key}' AS operation, CAST({rows} AS BIGINT) AS rows, "
        f"CAST({text} AS DOUBLE) AS value FROM source"
        for key, (rows, text) in fused.items()
    ]
    parts += [
        "SELECT 'value_counts', count(*), avg(n) FROM "
        "(SELECT fare_amt, count(*) AS n FROM source GROUP BY fare_amt)",
        "SELECT 'groupby', count(*), avg(fare_amt_mean) FROM lookup",
        "SELECT 'join', count(*), avg(fare_amt_mean) FROM joined",
        "SELECT 'join_count', 1, CAST(count(*) AS DOUBLE) FROM joined",
    ]
    union = " UNION ALL ".join(parts)
    return f"""WITH {TRIPS_SQL}, {ANGULAR_SQL},
        source AS (SELECT * FROM valued {where}), lookup AS ({spread_sql("source", None)}),
        joined AS (SELECT source.row_id, lookup.fare_amt_mean FROM source JOIN lookup
          ON source.row_id = lookup.passenger_count)
        SELECT '{name}' AS mode, operation, rows, round(value, 6) AS value FROM ({union})"""


QUERIES = {
    "row_count": Query(whole("count"), "SELECT count(*) AS value FROM events"),
    "row_id_count": Query(whole("count_index"), "SELECT count(event_id) AS value FROM events"),
    "mean_fare": Query(scalar("mean"), scalar_sql("mean")),
    "std_fare": Query(scalar("std"), scalar_sql("std")),
    "mean_sum": Query(scalar("mean_sum"), scalar_sql("mean_sum")),
    "mean_product": Query(scalar("mean_product"), scalar_sql("mean_product")),
    "mean_angular": Query(scalar("mean_complex"), scalar_sql("mean_complex")),
    "fare_value_counts": Query(
        value_counts,
        f"WITH {TRIPS_SQL} SELECT fare_amt, count(*) AS n FROM trips "
        "WHERE fare_amt IS NOT NULL GROUP BY fare_amt",
    ),
    "fare_value_counts_wide": Query(
        value_counts_wide,
        f"WITH {WIDE_SQL} SELECT fare_amt, count(*) AS n FROM trips_wide "
        "WHERE tip_amt BETWEEN 1 AND 5 GROUP BY fare_amt",
    ),
    "passenger_stats": Query(stats, f"WITH {TRIPS_SQL} {spread_sql('trips')}"),
    "passenger_stats_wide": Query(
        stats_wide,
        f"WITH {WIDE_SQL}, kept AS (SELECT * FROM trips_wide WHERE tip_amt BETWEEN 1 AND 5) "
        + spread_sql("kept"),
    ),
    "lookup_dimension": Query(
        lookup,
        f"WITH {TRIPS_SQL}, kept AS (SELECT * FROM trips WHERE tip_amt BETWEEN 1 AND 5) "
        + spread_sql("kept"),
    ),
    "row_id_join": Query(
        row_id_join,
        join_sql(
            TRIP_COLUMNS.replace("passenger_count", "trips.passenger_count")
            + ", "
            + ", ".join(f"round({name}, 6) AS {name}" for name in SPREAD)
        ),
    ),
    "row_id_join_count": Query(whole("join_count"), join_sql("count(*) AS value")),
    "workload_standard": Query(mode("standard"), mode_sql("standard")),
    "workload_filtered": Query(mode("filtered"), mode_sql("filtered")),
    "workload_cached": Query(mode("filtered_cached"), mode_sql("filtered_cached")),
    "pandas_api_workload": Query(
        pandas_surface,
        f"WITH {TRIPS_SQL}, kept AS (SELECT * FROM trips WHERE tip_amt BETWEEN 1 AND 5) "
        + spread_sql("kept"),
    ),
    "pandas_api_product": Query(
        pandas_values,
        f"WITH {TRIPS_SQL} SELECT row_id, round(fare_amt * tip_amt, 6) AS value FROM trips "
        "WHERE tip_amt BETWEEN 1 AND 5",
    ),
}
