"""Scan, canonicalisation, coercion, filter and expression queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.catalog.registry import Query, rounded, value
from fareline.catalog.views import (
    SPARSE_SQL,
    TIMED_SQL,
    TRIPS_SQL,
    WIDE_SQL,
    raw_trips,
    table,
    trips,
    trips_sparse,
    trips_timed,
    trips_wide,
)
from fareline.functions.trips import fare_band, pickup_hour, pickup_weekday, valid_month
from fareline.operators.profile import checksum, filter_retention, missing_profile
from fareline.operators.workload import (
    filter_tips,
    operation,
    operation_availability,
)
from fareline.plans.modelling.split import clean_fares, stage_features, with_time_features
from fareline.session import new_path
from fareline.sources.synthetic import synthetic_columns
from fareline.sources.trips import canonical_files, canonical_trips, coerced_trips

COORDINATE_COLUMNS = ("start_lon", "start_lat", "end_lon", "end_lat")
NUMBERS = (
    "fare_amt",
    "tip_amt",
    "passenger_count",
    "trip_distance",
    *COORDINATE_COLUMNS,
    "pickup_zone",
    "dropoff_zone",
)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def read_full(spark: SparkSession, folder: str) -> DataFrame:
    return checksum(trips(spark, folder), NUMBERS)


def ingest_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The event file read in two parts by time, reunited into one table."""
    events = table(spark, folder, "events")
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return events.where(F.col("ts") < noon).unionByName(events.where(F.col("ts") >= noon))


def ingest_mixed_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files of three kinds: with coordinates, with zones, and with both and other types."""
    raw = raw_trips(table(spark, folder, "events"))
    path = new_path(spark, "raw")
    ends = [name for name in raw.columns if name.endswith(("_longitude", "_latitude"))]
    zones = [name for name in raw.columns if name.endswith("LocationID")]
    number = F.col("row_id") % 3
    raw.where(number == 0).drop(*zones).write.parquet(f"{path}/0")
    whole = raw.withColumn("passenger_count", F.col("passenger_count").cast("int"))
    whole.where(number == 1).drop(*ends).write.parquet(f"{path}/1")
    texts = raw.withColumn("tip_amount", F.format_string("%.1f", "tip_amount"))
    texts = texts.withColumn("passenger_count", F.col("passenger_count").cast("double"))
    texts.where(number == 2).select(*reversed(raw.columns)).write.parquet(f"{path}/2")
    found = canonical_files(spark, f"{path}/*", keep={"row_id": F.col("row_id")})
    return rounded(found, COORDINATE_COLUMNS, 9)


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_trips(table(spark, folder, "events"))
    return rounded(canonical_trips(raw, keep=["row_id"]), COORDINATE_COLUMNS, 9)


def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with numbers and times as text, some of it malformed."""
    orders = table(spark, folder, "orders")
    case = F.col("o_orderkey") % 7
    price = F.col("o_totalprice").cast("string")
    number = F.when(case == 0, "n/a").when(case == 1, "12d").when(case == 2, "NaN").otherwise(price)
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    moment = F.when(case == 3, "not a time").when(case == 4, "2015-13-45").otherwise(text)
    raw = orders.select(
        F.col("o_orderkey").alias("row_id"),
        moment.alias("pickup_datetime"),
        number.alias("fare_amt"),
        F.col("o_custkey").alias("pickup_zone"),
    )
    return coerced_trips(raw, keep=["row_id"])


def by_row(name: str, digits: int = 6):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operation(trips(spark, folder), name).select("row_id", value(digits=digits))

    return run


def filtered(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(filter_tips(trips(spark, folder)), COORDINATE_COLUMNS, 9)


def filtered_wide(spark: SparkSession, folder: str) -> DataFrame:
    return filter_tips(trips_wide(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean_fares(trips(spark, folder)), COORDINATE_COLUMNS, 9)


def availability(spark: SparkSession, folder: str) -> DataFrame:
    """Both trip views: the one from line items has no coordinates."""
    parts = [("trips", trips(spark, folder)), ("trips_wide", trips_wide(spark, folder))]
    tables = [
        operation_availability(df).select(F.lit(name).alias("dataset"), "*") for name, df in parts
    ]
    return tables[0].unionByName(tables[1])


def completed_features(spark: SparkSession, folder: str) -> DataFrame:
    frame = with_time_features(trips(spark, folder))
    features = stage_features(frame.columns, "completed-trip")
    return rounded(frame.select("row_id", *features), COORDINATE_COLUMNS, 9)


def missing(spark: SparkSession, folder: str) -> DataFrame:
    return missing_profile(trips_sparse(spark, folder))


def retention(spark: SparkSession, folder: str) -> DataFrame:
    kept = filter_retention(trips_wide(spark, folder), F.col("tip_amt").between(1, 5))
    return rounded(kept, ["retention"], 9)


def time_features(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).select(
        "row_id", pickup_hour().alias("pickup_hour"), pickup_weekday().alias("pickup_weekday")
    )


def fare_bands(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).select(
        "row_id", "fare_amt", fare_band(F.col("fare_amt")).alias("band")
    )


def fare_band_counts(spark: SparkSession, folder: str) -> DataFrame:
    band = fare_band(F.col("fare_amt")).alias("band")
    return trips_timed(spark, folder).groupBy(band).agg(F.count("*").alias("n"))


def valid_months(spark: SparkSession, folder: str) -> DataFrame:
    """Order months written in three ways, of which one is valid."""
    orders = table(spark, folder, "orders")
    case = F.col("o_orderkey") % 3
    text = (
        F.when(case == 0, F.date_format("o_orderdate", "yyyy-MM"))
        .when(case == 1, F.date_format("o_orderdate", "yyyy/MM"))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01")))
    )
    months = orders.select(text.alias("month"), valid_month(text).alias("valid"))
    return months.groupBy("month", "valid").agg(F.count("*").alias("n"))


def synthetic(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic attributes drawn for the key of every event."""
    key = F.col("event_id")
    events = table(spark, folder, "events").select(key.alias("row_id"), *synthetic_columns(key))
    return rounded(events, ("trip_distance", *COORDINATE_COLUMNS))


ROUNDED_COORDINATES = ", ".join(f"round({c}, 9) AS {c}" for c in COORDINATE_COLUMNS)
TRIP_COLUMNS = (
    "row_id, pickup_datetime, fare_amt, tip_amt, passenger_count, trip_distance, "
    f"{ROUNDED_COORDINATES}, pickup_zone, dropoff_zone"
)

HALF_LON = "(radians(end_lon) - radians(start_lon)) / 2"
HALF_LAT = "(radians(end_lat) - radians(start_lat)) / 2"
ANGULAR_SQL = f"""angular AS (
  SELECT *, pow(sin({HALF_LON}), 2)
    + cos(radians(start_lon)) * cos(radians(end_lon)) * pow(sin({HALF_LAT}), 2) AS share
  FROM trips), valued AS (
  SELECT *, 2 * atan2(sqrt(share), sqrt(1 - share)) AS angle FROM angular)"""


def draw_sql(name: str) -> str:
    digits = f"substr(md5('42|{name}|' || event_id), 1, 13)"
    return f"(CAST('0x' || {digits} AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def uniform_sql(name: str, low: str, width: str) -> str:
    return f"CAST({low} AS DOUBLE) + ({width}) * {draw_sql(name)}"


def gamma_sql(name: str, scale: str) -> str:
    logs = f"ln(1 - {draw_sql(name + '1')}) + ln(1 - {draw_sql(name + '2')})"
    return f"CAST(-{scale} AS DOUBLE) * ({logs})"


LON_WIDTH = "CAST(-73.8 AS DOUBLE) - CAST(-74.05 AS DOUBLE)"
LAT_WIDTH = "CAST(40.9 AS DOUBLE) - CAST(40.65 AS DOUBLE)"
SYNTHETIC_SQL = f"""WITH drawn AS (
  SELECT event_id, {gamma_sql("distance", "1.8")} AS trip_distance,
    {gamma_sql("extra", "1.2")} AS extra
  FROM events), priced AS (
  SELECT *, round_even(3 + CAST(2.6 AS DOUBLE) * trip_distance + extra, 2) AS fare_amt FROM drawn)
SELECT event_id AS row_id,
  TIMESTAMP '2015-01-01' + to_seconds(CAST(floor(2678400 * {draw_sql("moment")}) AS BIGINT))
    AS pickup_datetime,
  fare_amt, round_even(fare_amt * (CAST(0.25 AS DOUBLE) * {draw_sql("tip")}), 2) AS tip_amt,
  CAST(1 + floor(6 * {draw_sql("passengers")}) AS DOUBLE) AS passenger_count,
  round(trip_distance, 6) AS trip_distance,
  round({uniform_sql("start_lon", "-74.05", LON_WIDTH)}, 6) AS start_lon,
  round({uniform_sql("start_lat", "40.65", LAT_WIDTH)}, 6) AS start_lat,
  round({uniform_sql("end_lon", "-74.05", LON_WIDTH)}, 6) AS end_lon,
  round({uniform_sql("end_lat", "40.65", LAT_WIDTH)}, 6) AS end_lat
FROM priced"""

AVAILABILITY_SQL = f"""WITH {TRIPS_SQL}, {WIDE_SQL}, operations AS (
  SELECT unnest(['count', 'count_index', 'mean', 'std', 'mean_sum', 'sum_columns', 'mean_product',
    'product_columns', 'value_counts', 'mean_complex', 'complex', 'groupby', 'join_count', 'join'])
    AS operation), inputs AS (
  SELECT 'trips' AS dataset, true AS coordinates, count(*) AS input_rows FROM trips
  UNION ALL SELECT 'trips_wide', false, count(*) FROM trips_wide), judged AS (
  SELECT *, NOT coordinates AND operation LIKE '%complex' AS lacking FROM inputs, operations)
SELECT dataset, operation, CASE WHEN lacking THEN 'skipped' ELSE 'ok' END AS status,
  CASE WHEN lacking THEN 'source lacks coordinates' ELSE '' END AS reason, input_rows
FROM judged"""

SPARSE_TYPES = {"row_id": "bigint", "pickup_datetime": "timestamp_ntz"} | {
    name: "double" for name in NUMBERS
}
MISSING_SQL = f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", '{kind}' AS dtype, count(*) - count({name}) AS missing "
    "FROM trips_sparse"
    for name, kind in SPARSE_TYPES.items()
)

QUERIES = {
    "read_table": Query(
        read_table, "SELECT event_id, ts, user_id, event_type, value, props FROM events"
    ),
    "read_full": Query(
        read_full,
        f"WITH {TRIPS_SQL} SELECT count(*) AS rows, "
        + ", ".join(f"round(avg({name}), 4) AS {name}_mean" for name in NUMBERS)
        + " FROM trips",
    ),
    "ingest_parts": Query(
        ingest_parts, "SELECT event_id, ts, user_id, event_type, value, props FROM events"
    ),
    "ingest_mixed_schema": Query(
        ingest_mixed_schema,
        f"""WITH {TRIPS_SQL} SELECT row_id, pickup_datetime, fare_amt, tip_amt, passenger_count,
          trip_distance, """
        + ", ".join(
            f"CASE WHEN row_id % 3 <> 1 THEN round({c}, 9) END AS {c}" for c in COORDINATE_COLUMNS
        )
        + """, CASE WHEN row_id % 3 <> 0 THEN pickup_zone END AS pickup_zone,
          CASE WHEN row_id % 3 <> 0 THEN dropoff_zone END AS dropoff_zone
        FROM trips""",
    ),
    "canonical_trips": Query(
        canonical,
        f"WITH {TRIPS_SQL} SELECT row_id, pickup_datetime, fare_amt, tip_amt, passenger_count, "
        f"trip_distance, {ROUNDED_COORDINATES}, pickup_zone, dropoff_zone FROM trips",
    ),
    "coerce_types": Query(
        coerce_types,
        """SELECT o_orderkey AS row_id,
          CASE WHEN o_orderkey % 7 IN (3, 4) THEN NULL ELSE o_orderdate END AS pickup_datetime,
          CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN NULL ELSE o_totalprice END AS fare_amt,
          CAST(o_custkey AS DOUBLE) AS pickup_zone
        FROM orders""",
    ),
    "sum_columns": Query(
        by_row("sum_columns"),
        f"WITH {TRIPS_SQL} SELECT row_id, round(fare_amt + tip_amt, 6) AS value FROM trips",
    ),
    "product_columns": Query(
        by_row("product_columns"),
        f"WITH {TRIPS_SQL} SELECT row_id, round(fare_amt * tip_amt, 6) AS value FROM trips",
    ),
    "angular_value": Query(
        by_row("complex", 9),
        f"WITH {TRIPS_SQL}, {ANGULAR_SQL} SELECT row_id, round(angle, 9) AS value FROM valued",
    ),
    "filter_tips": Query(
        filtered,
        f"WITH {TRIPS_SQL} SELECT {TRIP_COLUMNS} FROM trips WHERE tip_amt BETWEEN 1 AND 5",
    ),
    "filter_tips_wide": Query(
        filtered_wide, f"WITH {WIDE_SQL} SELECT * FROM trips_wide WHERE tip_amt BETWEEN 1 AND 5"
    ),
    "clean_fares": Query(
        clean,
        f"WITH {TRIPS_SQL} SELECT {TRIP_COLUMNS} FROM trips "
        "WHERE fare_amt BETWEEN 0.01 AND 500 AND pickup_datetime IS NOT NULL",
    ),
    "operation_availability": Query(availability, AVAILABILITY_SQL),
    "stage_features": Query(
        completed_features,
        f"""WITH {TRIPS_SQL} SELECT row_id, passenger_count,
          CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour,
          CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS pickup_weekday,
          {ROUNDED_COORDINATES}, pickup_zone, trip_distance, dropoff_zone
        FROM trips""",
    ),
    "missing_profile": Query(missing, MISSING_SQL),
    "filter_retention": Query(
        retention,
        f"""WITH {WIDE_SQL} SELECT count(*) FILTER (tip_amt BETWEEN 1 AND 5) AS kept,
          count(*) AS rows,
          round(count(*) FILTER (tip_amt BETWEEN 1 AND 5) / count(*), 9) AS retention
        FROM trips_wide""",
    ),
    "time_features": Query(
        time_features,
        f"""WITH {TRIPS_SQL} SELECT row_id, CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour,
          CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS pickup_weekday
        FROM trips""",
    ),
    "fare_bands": Query(
        fare_bands,
        f"""WITH {TRIPS_SQL} SELECT row_id, fare_amt, CAST(CASE WHEN fare_amt < 10 THEN 0
          WHEN fare_amt < 25 THEN 1 ELSE 2 END AS INTEGER) AS band
        FROM trips""",
    ),
    "fare_band_counts": Query(
        fare_band_counts,
        f"""WITH {TIMED_SQL} SELECT CAST(CASE WHEN fare_amt < 10 THEN 0 WHEN fare_amt < 25 THEN 1
          ELSE 2 END AS INTEGER) AS band, count(*) AS n
        FROM trips_timed GROUP BY 1""",
    ),
    "valid_months": Query(
        valid_months,
        """WITH texts AS (
          SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m')
            WHEN 1 THEN strftime(o_orderdate, '%Y/%m')
            ELSE strftime(o_orderdate, '%Y-%m') || '-01' END AS month
          FROM orders)
        SELECT month, regexp_matches(month, '^20[0-9]{2}-(0[1-9]|1[0-2])$') AS valid,
          count(*) AS n
        FROM texts GROUP BY 1, 2""",
    ),
    "synthetic_trips": Query(synthetic, SYNTHETIC_SQL),
}
