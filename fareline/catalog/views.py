"""Trip-shaped views of the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.sources.trips import canonical_trips, load_trips

BACKENDS = ("pandas", "dask", "spark")
MODES = ("standard", "filtered", "filtered_cached")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_trips(spark, f"{folder}/{name}.parquet")


def spread_out(low: str, factor: int) -> Column:
    """Coordinate between ``low`` and ``low`` + 0.25 derived from the event number."""
    return F.expr(f"{low}D + 0.25D * ((event_id * {factor}) % 1000) / 1000")


def raw_trips(events: DataFrame) -> DataFrame:
    """Events under the raw column names of a trip file, plus a column no trip file has."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("ts").alias("tpep_pickup_datetime"),
        F.col("value").alias("fare_amount"),
        (k / 10).alias("tip_amount"),
        (1 + F.col("user_id") % 6).alias("passenger_count"),
        (F.col("value") / 3).alias("trip_distance"),
        spread_out("-74.05", 7919).alias("pickup_longitude"),
        spread_out("40.65", 104729).alias("pickup_latitude"),
        spread_out("-74.05", 1299709).alias("dropoff_longitude"),
        spread_out("40.65", 15485863).alias("dropoff_latitude"),
        F.col("user_id").alias("PULocationID"),
        k.alias("DOLocationID"),
        F.col("event_type").alias("store_and_fwd_flag"),
    )


def trips(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_trips(raw_trips(table(spark, folder, "events")), keep=["row_id"])


def trips_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trips without key and coordinates."""
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("pickup_datetime"),
        F.col("l_extendedprice").alias("fare_amt"),
        F.col("l_quantity").alias("tip_amt"),
        F.col("l_linenumber").cast("double").alias("passenger_count"),
        F.col("l_suppkey").cast("double").alias("pickup_zone"),
        F.col("l_partkey").cast("double").alias("dropoff_zone"),
    )


def trips_timed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as trips with heavily tied pickup times and rare zones."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("pickup_datetime"),
        (F.col("o_totalprice") / 10000).alias("fare_amt"),
        (1 + F.col("o_orderkey") % 6).cast("double").alias("passenger_count"),
        F.col("o_custkey").cast("double").alias("pickup_zone"),
    )


def trips_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Trips with missing values: no distance without a tip of 1, no zone for six passengers."""
    full = trips(spark, folder)
    return full.withColumns(
        {
            "trip_distance": F.when(F.col("tip_amt") >= 1, F.col("trip_distance")),
            "pickup_zone": F.when(F.col("passenger_count") < 6, F.col("pickup_zone")),
            "end_lon": F.lit(None).cast("double"),
        }
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Events as measurement records of three backends."""
    number = F.col("event_id")
    status = F.when(number % 10 == 0, "skipped").when(number % 97 == 5, "error").otherwise("ok")
    events = table(spark, folder, "events").withColumn("status", status)
    seconds = F.when(F.col("status") == "ok", F.col("value") / 1000)
    backends = F.array(*[F.lit(name) for name in BACKENDS])
    modes = F.array(*[F.lit(name) for name in MODES])
    construct = F.when(F.col("event_type") == "error", "read_construct")
    reason = F.when(F.col("status") == "ok", "").otherwise(F.concat(F.lit("is "), "status"))
    return events.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("source_file"),
        F.get(backends, (F.col("user_id") % 3).cast("int")).alias("backend"),
        F.get(modes, (number % 3).cast("int")).alias("mode"),
        F.coalesce(construct, F.col("event_type")).alias("operation"),
        F.lit("events").alias("dataset"),
        F.col("event_id").alias("input_rows"),
        (number % 4).cast("int").alias("repeat"),
        "status",
        seconds.alias("seconds"),
        reason.alias("reason"),
        F.array_sort(F.array_distinct(F.array("event_type", "status"))).alias("warnings"),
        (F.col("status") == "ok").alias("validated"),
    )


K_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def spread_sql(low: str, factor: int) -> str:
    low, share = f"CAST({low} AS DOUBLE)", "CAST(0.25 AS DOUBLE)"
    return f"{low} + {share} * ((event_id * {factor}) % 1000) / 1000"


TRIPS_SQL = f"""trips AS (
  SELECT event_id AS row_id, ts AS pickup_datetime, value AS fare_amt, {K_SQL} / 10 AS tip_amt,
    CAST(1 + user_id % 6 AS DOUBLE) AS passenger_count, value / 3 AS trip_distance,
    {spread_sql("-74.05", 7919)} AS start_lon,
    {spread_sql("40.65", 104729)} AS start_lat,
    {spread_sql("-74.05", 1299709)} AS end_lon,
    {spread_sql("40.65", 15485863)} AS end_lat,
    CAST(user_id AS DOUBLE) AS pickup_zone, {K_SQL} AS dropoff_zone
  FROM events)"""

WIDE_SQL = """trips_wide AS (
  SELECT l_shipdate AS pickup_datetime, l_extendedprice AS fare_amt, l_quantity AS tip_amt,
    CAST(l_linenumber AS DOUBLE) AS passenger_count, CAST(l_suppkey AS DOUBLE) AS pickup_zone,
    CAST(l_partkey AS DOUBLE) AS dropoff_zone
  FROM lineitem)"""

TIMED_SQL = """trips_timed AS (
  SELECT o_orderkey AS row_id, o_orderdate AS pickup_datetime, o_totalprice / 10000 AS fare_amt,
    CAST(1 + o_orderkey % 6 AS DOUBLE) AS passenger_count, CAST(o_custkey AS DOUBLE) AS pickup_zone
  FROM orders)"""

SPARSE_SQL = f"""{TRIPS_SQL}, trips_sparse AS (
  SELECT * REPLACE (
    CASE WHEN tip_amt >= 1 THEN trip_distance END AS trip_distance,
    CASE WHEN passenger_count < 6 THEN pickup_zone END AS pickup_zone,
    CAST(NULL AS DOUBLE) AS end_lon)
  FROM trips)"""

MEASUREMENTS_SQL = """flagged AS (
  SELECT *, CASE WHEN event_id % 10 = 0 THEN 'skipped' WHEN event_id % 97 = 5 THEN 'error'
    ELSE 'ok' END AS status
  FROM events), measurements AS (
  SELECT 'run-' || user_id AS source_file, ['pandas', 'dask', 'spark'][1 + user_id % 3] AS backend,
    ['standard', 'filtered', 'filtered_cached'][1 + event_id % 3] AS mode,
    CASE WHEN event_type = 'error' THEN 'read_construct' ELSE event_type END AS operation,
    'events' AS dataset, event_id AS input_rows, CAST(event_id % 4 AS INTEGER) AS repeat, status,
    CASE WHEN status = 'ok' THEN value / 1000 END AS seconds,
    CASE WHEN status = 'ok' THEN '' ELSE 'is ' || status END AS reason,
    CASE WHEN event_type = status THEN event_type
      ELSE least(event_type, status) || '; ' || greatest(event_type, status) END AS warnings,
    status = 'ok' AS validated
  FROM flagged)"""
