"""Sample, rank, order and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.catalog.registry import Query
from fareline.catalog.views import TIMED_SQL, TRIPS_SQL, table, trips, trips_timed
from fareline.operators.ranking import ranked_by_priority, with_position
from fareline.operators.sampling import budget_sample, nested_samples, priority_sample
from fareline.plans.modelling.split import (
    MOMENT,
    chronological_split,
    clean_fares,
    expanding_folds,
)
from fareline.session import new_path
from fareline.sources.samples import sample_manifest, sample_rows, write_samples

# Sample sizes are the operator's parameter; the ranking runs over the whole table.
SIZES = (200, 400, 800)
BUDGET = 700


def events_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "value")


def one_sample(spark: SparkSession, folder: str) -> DataFrame:
    return priority_sample(events_by_key(spark, folder), SIZES[1], key="event_id")


def nested(spark: SparkSession, folder: str) -> DataFrame:
    return nested_samples(events_by_key(spark, folder), SIZES, key="event_id")


def nested_trips(spark: SparkSession, folder: str) -> DataFrame:
    whole = trips(spark, folder).withColumnRenamed("row_id", "source_id")
    return nested_samples(whole, SIZES, key="source_id")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return sample_rows(nested_trips(spark, folder))


def written_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of samples that were written, a row for each, with the rows of its files."""
    path = new_path(spark, "samples")
    write_samples(nested_trips(spark, folder), SIZES, path)
    origin = F.struct(F.lit("files").alias("kind"), F.lit("events.parquet").alias("source_file"))
    told = sample_manifest(spark, path, origin, 42)
    entries = told.select("origin.kind", "sampling", "seed", "coordinates_available", F.explode("datasets").alias("d"))
    return entries.select(
        F.col("d.label").alias("label"),
        F.col("d.rows").alias("rows"),
        F.col("d.path").alias("path"),
        (F.col("d.bytes") > 0).alias("has_bytes"),
        F.length("d.sha256").alias("digest_length"),
        "kind",
        "sampling",
        "seed",
        "coordinates_available",
    )


def sample_files(spark: SparkSession, folder: str) -> DataFrame:
    """Nested samples written as Parquet and read back, each row with the file set it is in."""
    path = new_path(spark, "samples")
    write_samples(nested(spark, folder), SIZES, path)
    parts = [
        spark.read.parquet(f"{path}/{label}").select(F.lit(label).alias("sample"), "*")
        for label in ("small", "medium", "large")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dense_row_id(spark: SparkSession, folder: str) -> DataFrame:
    timed = trips_timed(spark, folder).select(F.col("row_id").alias("source_id"), MOMENT)
    return ranked_by_priority(timed, key="source_id")


def split_boundary(spark: SparkSession, folder: str) -> DataFrame:
    split = chronological_split(trips_timed(spark, folder))
    return split.test.agg(F.min(MOMENT).alias("boundary"), F.count("*").alias("test_rows"))


def time_positions(spark: SparkSession, folder: str) -> DataFrame:
    timed = trips_timed(spark, folder).select("row_id", MOMENT)
    return with_position(timed, [MOMENT, "row_id"])


def both_sides(spark: SparkSession, folder: str) -> DataFrame:
    split = chronological_split(trips_timed(spark, folder))
    sides = [(split.train, "train"), (split.test, "test")]
    parts = [df.select("row_id", MOMENT, F.lit(role).alias("role")) for df, role in sides]
    return parts[0].unionByName(parts[1])


def folds(spark: SparkSession, folder: str) -> DataFrame:
    return expanding_folds(trips_timed(spark, folder))


def budget(spark: SparkSession, folder: str) -> DataFrame:
    clean = clean_fares(trips(spark, folder)).select("row_id", MOMENT, "fare_amt")
    return budget_sample(clean, BUDGET)


def first_trips(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder).orderBy("row_id").limit(5).select("row_id", MOMENT, "fare_amt")


def priority_sql(key: str, columns: str, source: str, where: str = "") -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY md5('42|' || {key})) - 1 AS row_id, {columns} "
        f"FROM {source} {where}"
    )


RANKED_EVENTS = f"ranked AS ({priority_sql('event_id', 'event_id, ts, value', 'events')})"
LABEL_SQL = (
    f"CASE WHEN row_id < {SIZES[0]} THEN 'small' WHEN row_id < {SIZES[1]} THEN 'medium' "
    "ELSE 'large' END AS sample"
)
BOUNDARY_SQL = f"""{TIMED_SQL}, positions AS (
  SELECT *, row_number() OVER (ORDER BY pickup_datetime, row_id) - 1 AS position,
    count(*) OVER () AS n
  FROM trips_timed), cut AS (
  SELECT pickup_datetime AS boundary FROM positions
  WHERE position = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT))"""
FOLDS_SQL = f"""WITH {BOUNDARY_SQL}, parts AS (
  SELECT n - (3 - fold) * (n // 4) AS start, n - (2 - fold) * (n // 4) AS stop, fold
  FROM (SELECT count(*) AS n FROM trips_timed), (SELECT unnest([0, 1, 2]) AS fold)), starts AS (
  SELECT parts.*, pickup_datetime AS first_test FROM parts
  JOIN positions ON positions.position = parts.start)
SELECT CAST(fold AS INTEGER) AS fold, 'train' AS role, row_id FROM positions
JOIN starts ON pickup_datetime < first_test
UNION ALL SELECT CAST(fold AS INTEGER), 'test', row_id FROM positions
JOIN starts ON position >= start AND position < stop"""

QUERIES = {
    "priority_sample": Query(
        one_sample, f"WITH {RANKED_EVENTS} SELECT * FROM ranked WHERE row_id < {SIZES[1]}"
    ),
    "nested_samples": Query(
        nested,
        f"WITH {RANKED_EVENTS} SELECT *, {LABEL_SQL} FROM ranked WHERE row_id < {SIZES[2]}",
    ),
    "sample_manifest": Query(
        manifest,
        f"""WITH sizes AS (SELECT unnest(['small', 'medium', 'large']) AS label,
            unnest([{SIZES[0]}, {SIZES[1]}, {SIZES[2]}]) AS size)
        SELECT label, least(size, (SELECT count(*) FROM events)) AS rows,
          true AS coordinates_available
        FROM sizes""",
    ),
    "written_manifest": Query(
        written_manifest,
        f"""WITH sizes AS (SELECT unnest(['small', 'medium', 'large']) AS label,
            unnest([{SIZES[0]}, {SIZES[1]}, {SIZES[2]}]) AS size)
        SELECT label, least(size, (SELECT count(*) FROM events)) AS rows, label AS path,
          true AS has_bytes, 64 AS digest_length, 'files' AS kind,
          'nested random-priority samples' AS sampling, 42 AS seed, true AS coordinates_available
        FROM sizes""",
    ),
    "sample_files": Query(
        sample_files,
        f"""WITH {RANKED_EVENTS}, sizes AS (
            SELECT unnest(['small', 'medium', 'large']) AS sample,
              unnest([{SIZES[0]}, {SIZES[1]}, {SIZES[2]}]) AS size)
        SELECT sample, row_id, event_id, ts, value FROM sizes JOIN ranked ON row_id < size""",
    ),
    "dense_row_id": Query(
        dense_row_id,
        f"WITH {TIMED_SQL} "
        + priority_sql("row_id", "row_id AS source_id, pickup_datetime", "trips_timed"),
    ),
    "split_boundary": Query(
        split_boundary,
        f"""WITH {BOUNDARY_SQL} SELECT boundary, count(*) AS test_rows
        FROM positions JOIN cut ON pickup_datetime >= boundary GROUP BY boundary""",
    ),
    "time_ordered": Query(
        time_positions,
        f"WITH {BOUNDARY_SQL} SELECT position, row_id, pickup_datetime FROM positions",
    ),
    "chronological_split": Query(
        both_sides,
        f"""WITH {BOUNDARY_SQL} SELECT row_id, pickup_datetime,
          CASE WHEN pickup_datetime < (SELECT boundary FROM cut) THEN 'train' ELSE 'test' END
            AS role
        FROM positions""",
    ),
    "expanding_folds": Query(folds, FOLDS_SQL),
    "budget_sample": Query(
        budget,
        f"""WITH {TRIPS_SQL} SELECT row_id, pickup_datetime, fare_amt FROM trips
        WHERE fare_amt BETWEEN 0.01 AND 500 ORDER BY md5('42|' || row_id) LIMIT {BUDGET}""",
    ),
    "first_trips": Query(
        first_trips,
        f"WITH {TRIPS_SQL} SELECT row_id, pickup_datetime, fare_amt FROM trips "
        "ORDER BY row_id LIMIT 5",
    ),
}
