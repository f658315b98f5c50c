"""Synthetic trips with the schema of a real trip table, for software checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.functions.draws import gamma2_draw, integer_draw, uniform_draw

# Parameters of the synthetic distributions.
FIRST_MOMENT = "2015-01-01"
SECONDS = 31 * 86_400
LON_RANGE = (-74.05, -73.8)
LAT_RANGE = (40.65, 40.9)


def synthetic_columns(key: Column, seed: int = 42) -> list[Column]:
    """Trip attributes drawn from ``key`` and ``seed`` alone."""
    distance = gamma2_draw(key, seed, "distance", 1.8)
    fare = F.bround(3 + 2.6 * distance + gamma2_draw(key, seed, "extra", 1.2), 2)
    tip = F.bround(fare * uniform_draw(key, seed, "tip", 0.0, 0.25), 2)
    offset = F.make_dt_interval(secs=integer_draw(key, seed, "moment", 0, SECONDS))
    moment = F.lit(FIRST_MOMENT).cast("timestamp_ntz") + offset
    return [
        moment.alias("pickup_datetime"),
        fare.alias("fare_amt"),
        tip.alias("tip_amt"),
        integer_draw(key, seed, "passengers", 1, 7).cast("double").alias("passenger_count"),
        distance.alias("trip_distance"),
        uniform_draw(key, seed, "start_lon", *LON_RANGE).alias("start_lon"),
        uniform_draw(key, seed, "start_lat", *LAT_RANGE).alias("start_lat"),
        uniform_draw(key, seed, "end_lon", *LON_RANGE).alias("end_lon"),
        uniform_draw(key, seed, "end_lat", *LAT_RANGE).alias("end_lat"),
    ]


def synthetic_trips(spark: SparkSession, rows: int = 20_000, seed: int = 42) -> DataFrame:
    """``rows`` trips; the first n of any size are the same trips, on any partitioning."""
    ids = spark.range(rows).withColumnRenamed("id", "row_id")
    return ids.select("row_id", *synthetic_columns(F.col("row_id"), seed))
