"""Comparison and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.catalog.registry import Query, rounded
from fareline.catalog.views import TRIPS_SQL, table, trips
from fareline.operators.compare import tolerant_diff, tolerant_diff_of_unique
from fareline.operators.profile import file_fingerprint

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def diff(spark: SparkSession, folder: str) -> DataFrame:
    """All trips against a copy with every kind of damage, spread by the row number."""
    number = F.col("row_id")
    whole = trips(spark, folder).select("row_id", "fare_amt", "tip_amt")
    fare = (
        F.when(number % 7 == 0, F.col("fare_amt") * 1.01)
        .when(number % 7 == 1, F.col("fare_amt") * (1 + 1e-7))
        .otherwise(F.col("fare_amt"))
    )
    tip = F.when(number % 11 != 0, F.col("tip_amt"))
    copies = F.when(number % 17 == 0, 2).otherwise(1)
    damaged = whole.where(number % 19 != 0).select(
        "row_id",
        fare.alias("fare_amt"),
        tip.alias("tip_amt"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    )
    found = tolerant_diff(whole.where(number % 13 != 0), damaged.drop("copy"), ["row_id"])
    return rounded(found, ["actual", "expected"])


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    paths = [f"{folder}/{name}.parquet" for name in TABLES]
    return file_fingerprint(spark, *paths).select("file", "bytes", "sha256")


def special(spark: SparkSession, folder: str, compare=tolerant_diff) -> DataFrame:
    """Events against a copy, with infinities, NaN and missing values on either side by number."""
    number = F.col("event_id")
    values = {0: "inf", 1: "-inf", 2: "nan"}

    def damaged(shift: int) -> Column:
        value = F.col("value")
        for rest, text in values.items():
            value = F.when((number + shift) % 7 == rest, F.lit(float(text))).otherwise(value)
        return F.when((number + shift) % 7 != 3, value).alias("value")

    events = table(spark, folder, "events")
    sides = [events.select("event_id", damaged(shift)) for shift in (0, 1)]
    same = [side.where(number % 2 == 0).withColumn("event_id", -number - 1) for side in sides[:1] * 2]
    found = compare(sides[0].unionByName(same[0]), sides[1].unionByName(same[1]), ["event_id"])
    # Infinite values are named, as engines write them in their own way.
    named = [
        F.when(F.abs(name) == float("inf"), F.when(F.col(name) > 0, "+").otherwise("-"))
        .otherwise("finite")
        .alias(name)
        for name in ("actual", "expected")
    ]
    return found.select("event_id", "column", "reason", *named)


def special_by_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same, where only buckets of keys whose checksums differ are compared."""
    return special(spark, folder, tolerant_diff_of_unique)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def special_sql(shift: int) -> str:
    rest = f"(event_id + {shift}) % 7"
    return (
        f"CASE {rest} WHEN 0 THEN CAST('inf' AS DOUBLE) WHEN 1 THEN CAST('-inf' AS DOUBLE) "
        f"WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE value END"
    )


def sign_sql(name: str) -> str:
    return f"CASE WHEN isinf({name}) THEN CASE WHEN {name} > 0 THEN '+' ELSE '-' END ELSE 'finite' END"


SPECIAL_SQL = f"""WITH sides AS (
  SELECT event_id, {special_sql(0)} AS a, {special_sql(1)} AS e FROM events), judged AS (
  SELECT *, CASE WHEN (a IS NULL) <> (e IS NULL) THEN 'null'
    WHEN a IS NULL THEN NULL
    WHEN isinf(a) OR isinf(e) THEN CASE WHEN a <> e THEN 'value' END
    WHEN abs(a - e) > CAST(1e-8 AS DOUBLE) + CAST(1e-5 AS DOUBLE) * abs(e) THEN 'value' END AS reason
  FROM sides)
SELECT event_id, 'value' AS "column", reason, coalesce({sign_sql("a")}, 'finite') AS actual,
  coalesce({sign_sql("e")}, 'finite') AS expected
FROM judged WHERE reason IS NOT NULL"""

DIFF_SQL = f"""WITH {TRIPS_SQL}, actual AS (
  SELECT row_id, fare_amt, tip_amt FROM trips WHERE row_id % 13 <> 0), expected AS (
  SELECT row_id, CASE row_id % 7 WHEN 0 THEN fare_amt * CAST(1.01 AS DOUBLE)
      WHEN 1 THEN fare_amt * (1 + CAST(1e-7 AS DOUBLE)) ELSE fare_amt END AS fare_amt,
    CASE WHEN row_id % 11 <> 0 THEN tip_amt END AS tip_amt,
    CASE WHEN row_id % 17 = 0 THEN 2 ELSE 1 END AS copies
  FROM trips WHERE row_id % 19 <> 0), paired AS (
  SELECT coalesce(a.row_id, e.row_id) AS row_id, a.row_id IS NULL AS no_a, e.row_id IS NULL AS no_e,
    e.copies, a.fare_amt AS fare_a, e.fare_amt AS fare_e, a.tip_amt AS tip_a, e.tip_amt AS tip_e
  FROM actual a FULL JOIN expected e ON a.row_id = e.row_id), whole_rows AS (
  SELECT row_id, CASE WHEN copies > 1 THEN 'duplicate' WHEN no_a THEN 'missing'
    WHEN no_e THEN 'extra' END AS reason
  FROM paired), cells AS (
  SELECT row_id, 'fare_amt' AS "column", fare_a AS actual, fare_e AS expected FROM paired
  UNION ALL SELECT row_id, 'tip_amt', tip_a, tip_e FROM paired), judged AS (
  SELECT cells.*, CASE WHEN (actual IS NULL) <> (expected IS NULL) THEN 'null'
    WHEN abs(actual - expected) > CAST(1e-8 AS DOUBLE) + CAST(1e-5 AS DOUBLE) * abs(expected)
      THEN 'value' END AS reason
  FROM cells JOIN whole_rows USING (row_id) WHERE whole_rows.reason IS NULL)
SELECT row_id, "column", reason, round(actual, 6) AS actual, round(expected, 6) AS expected
FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT row_id, NULL, reason, NULL, NULL FROM whole_rows WHERE reason IS NOT NULL"""

QUERIES = {
    "tolerant_diff": Query(diff, DIFF_SQL),
    "tolerant_diff_special": Query(special, SPECIAL_SQL),
    "tolerant_diff_buckets": Query(special_by_buckets, SPECIAL_SQL),
    "document_digests": Query(digests, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "file_fingerprint": Query(fingerprints),
}
