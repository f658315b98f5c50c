import math

import pytest
from conftest import plan_of
from pyspark.sql import Row
from pyspark.sql import functions as F

from fareline.functions.trips import fare_band, pickup_weekday, valid_month
from fareline.operators.profile import filter_retention, missing_profile
from fareline.operators.workload import (
    NO_COORDINATES,
    OPERATIONS,
    operation,
    operation_availability,
)
from fareline.sources.trips import (
    ALIASES,
    canonical_files,
    canonical_trips,
    coerced_trips,
    literal_path,
    load_trips,
    renamed_trips,
    row_identity,
)

RAW = "tpep_pickup_datetime string, fare_amount string, tip_amount double, passenger_count bigint"


def raw(spark, rows, extra="trip_distance float, unknown string"):
    return spark.createDataFrame(rows, f"{RAW}, {extra}")


def test_canonical_names_types_and_dropped_columns(spark):
    df = canonical_trips(raw(spark, [("2015-01-02 03:04:05", "7.5", 1.0, 2, 1.5, "x")]))
    assert df.dtypes == [
        ("pickup_datetime", "timestamp_ntz"),
        ("fare_amt", "double"),
        ("tip_amt", "double"),
        ("passenger_count", "double"),
        ("trip_distance", "double"),
    ]
    assert df.first().fare_amt == 7.5


def test_malformed_values_become_null(spark):
    texts = ["abc", "", "12d", "3F", "NaN", None]
    rows = [("not a time", text, 1.0, 1, 1.0, "") for text in texts]
    df = canonical_trips(raw(spark, rows))
    assert df.where("fare_amt IS NOT NULL OR pickup_datetime IS NOT NULL").count() == 0


def test_well_formed_numbers_survive(spark):
    rows = [("2015-01-01", text, 1.0, 1, 1.0, "") for text in ["1e2", " 5 ", "-3.25", "inf"]]
    values = [row.fare_amt for row in canonical_trips(raw(spark, rows)).collect()]
    assert values == [100.0, 5.0, -3.25, math.inf]


def test_nan_is_missing_after_ingest(spark):
    rows = [("2015-01-01", "1", tip, 1, 1.0, "") for tip in (math.nan, 2.0, 4.0)]
    df = canonical_trips(raw(spark, rows))
    assert df.agg(F.avg("tip_amt")).first()[0] == 3.0
    assert df.where(F.col("tip_amt") >= 1).count() == 2


def test_numeric_times_count_nanoseconds(spark):
    df = spark.createDataFrame([(1_420_070_400_500_000_000,)], "pickup_datetime bigint")
    text = coerced_trips(df).first().pickup_datetime.isoformat()
    assert text == "2015-01-01T00:00:00.500000"


def test_missing_required_columns_are_named(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "fare_amount double, trip_distance double")
    with pytest.raises(ValueError, match=r"\['passenger_count', 'pickup_datetime', 'tip_amt'\]"):
        canonical_trips(df)


def test_alias_map_covers_every_raw_name(spark):
    schema = ", ".join(f"{name} double" for name in ALIASES)
    df = renamed_trips(spark.createDataFrame([tuple([1.0] * len(ALIASES))], schema))
    assert df.columns == list(ALIASES.values())


def test_row_identity_is_unique_and_stable(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).repartition(5).write.parquet(path)
    ids = load_trips(spark, path).withColumn("key", row_identity())
    first = {(r.id, r.key) for r in ids.collect()}
    assert len({key for _, key in first}) == 1000
    assert first == {(r.id, r.key) for r in ids.repartition(3).collect()}


def test_operations_without_coordinates_are_skipped(spark):
    schema = "row_id bigint, fare_amt double, tip_amt double, passenger_count double"
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)], schema)
    rows = operation_availability(df).collect()
    assert [row.operation for row in rows] == list(OPERATIONS)
    skipped = {row.operation: row.reason for row in rows if row.status == "skipped"}
    assert skipped == {"complex": NO_COORDINATES, "mean_complex": NO_COORDINATES}
    assert {row.input_rows for row in rows} == {2}
    with pytest.raises(ValueError, match=NO_COORDINATES):
        operation(df, "complex")
    with pytest.raises(ValueError, match="unknown operation"):
        operation(df, "median")


def test_fare_bands_and_weekday(spark):
    fares = spark.createDataFrame([(9.99,), (10.0,), (24.99,), (25.0,), (None,)], "fare double")
    bands = [row[0] for row in fares.select(fare_band(F.col("fare"))).collect()]
    assert bands == [0, 1, 1, 2, None]
    monday = spark.sql("SELECT timestamp_ntz'2015-01-05 10:00:00' AS pickup_datetime")
    assert monday.select(pickup_weekday()).first()[0] == 0


def test_month_text(spark):
    texts = ["2015-01", "2015-13", "1999-01", "2015-1", "2015-12", " 2015-12", "2015-12\n"]
    df = spark.createDataFrame([(text,) for text in texts], "month string")
    valid = [row.month for row in df.where(valid_month(F.col("month"))).collect()]
    assert [text for text in valid if text.strip() == text] == ["2015-01", "2015-12"]


def test_missing_profile_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (None, math.nan), (3, None)], "a int, b double")
    assert missing_profile(df).collect() == [
        Row(column="a", dtype="int", missing=1),
        Row(column="b", dtype="double", missing=2),
    ]


def test_retention_rejects_unknown(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,), (5.0,)], "tip double")
    row = filter_retention(df, F.col("tip").between(1, 5)).first()
    assert (row.kept, row.rows, row.retention) == (2, 4, 0.5)


def test_numeric_times_out_of_range_are_missing(spark):
    from fareline.sources.trips import as_moment

    rows = [(1, 0.0), (2, 1.5e18), (3, 1e300), (4, float("nan")), (5, float("inf")), (6, None), (7, -9.3e18)]
    df = spark.createDataFrame(rows, "id int, t double")
    found = {r.id: r.m for r in df.select("id", as_moment("t", df.schema["t"].dataType).alias("m")).collect()}
    assert str(found[1]) == "1970-01-01 00:00:00" and str(found[2]) == "2017-07-14 02:40:00"
    assert [found[k] for k in (3, 5, 6, 7)] == [None] * 4


def test_month_text_must_end(spark):
    from fareline.functions.trips import valid_month

    rows = spark.createDataFrame([("2015-01",), ("2015-01\n",), ("2015-13",)], "m string")
    assert [r[0] for r in rows.select(valid_month(rows.m)).collect()] == [True, False, False]


def test_row_identity_tells_folders_apart(spark, tmp_path):
    from fareline.sources.trips import row_identity

    folders = [str(tmp_path / name) for name in ("one x", "two")]
    for folder in folders:
        spark.range(3).coalesce(1).write.parquet(folder)
        part = next(p for p in __import__("pathlib").Path(folder).glob("part-*.parquet"))
        part.rename(part.with_name("part-0.parquet"))
    rows = spark.read.option("recursiveFileLookup", True).parquet(*folders)
    keys = {r[0] for r in rows.select(row_identity(folders)).collect()}
    assert len(keys) == 6 and all(str(tmp_path) not in key for key in keys)


def raw_file(spark, path, columns, count=200):
    spark.range(count).selectExpr(
        "timestamp_ntz'2015-01-01' + make_dt_interval(0, 0, cast(id AS int)) AS tpep_pickup_datetime",
        *columns,
    ).write.parquet(path)


COMMON = ["id + 0.5D AS fare_amount", "id / 100 AS tip_amount", "cast(id AS double) AS trip_distance"]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_files_of_varying_columns(spark, tmp_path, order):
    kinds = [
        ["cast(id AS double) AS passenger_count", "-73D AS pickup_longitude", "40D AS pickup_latitude"],
        ["id AS passenger_count", "id % 5 AS PULocationID"],
        ["cast(id AS string) AS passenger_count", "cast(id AS int) % 7 AS PULocationID", "1 AS other"],
    ]
    # Names with characters that a path pattern or a URL would change.
    names = [str(tmp_path / name) for name in ("month 1", "month[2]", "month%203")]
    for name, kind in zip(names, kinds, strict=True):
        raw_file(spark, name, COMMON + kind)
    paths = [literal_path(names[k]) for k in order]
    found = canonical_files(spark, *paths)
    assert "other" not in found.columns and found.count() == 600
    assert {t for c, t in found.dtypes if c != "pickup_datetime"} == {"double"}
    row = found.agg(*[F.count(c).alias(c) for c in ("passenger_count", "start_lon", "pickup_zone")]).first()
    assert (row.passenger_count, row.start_lon, row.pickup_zone) == (600, 200, 400)
    assert found.agg(F.sum("passenger_count")).first()[0] == 3 * sum(range(200))


def test_varying_files_in_one_folder_prune_columns(spark, tmp_path):
    folder = str(tmp_path / "raw")
    raw_file(spark, f"{folder}/a", [*COMMON, "id AS passenger_count", "id AS PULocationID"])
    raw_file(spark, f"{folder}/b", [*COMMON, "id AS passenger_count", "-73D AS pickup_longitude"])
    found = canonical_files(spark, f"{folder}/*")
    plan = plan_of(found.select("fare_amt", "pickup_zone"))
    assert plan.count("FileScan parquet") == 2
    assert "ReadSchema: struct<fare_amount:double,PULocationID:bigint>" in plan
    assert "ReadSchema: struct<fare_amount:double>" in plan


def test_a_file_without_a_required_column_is_named(spark, tmp_path):
    raw_file(spark, str(tmp_path / "a"), [*COMMON, "id AS passenger_count"])
    raw_file(spark, str(tmp_path / "b"), COMMON)
    with pytest.raises(ValueError, match="passenger_count.*/b/"):
        canonical_files(spark, str(tmp_path / "*"))


def test_mixed_pickup_times(spark, tmp_path):
    raw_file(spark, str(tmp_path / "a"), [*COMMON, "id AS passenger_count"], 5)
    moments = spark.read.parquet(str(tmp_path / "a")).withColumn(
        "tpep_pickup_datetime", F.col("tpep_pickup_datetime").cast("timestamp")
    )
    moments.write.parquet(str(tmp_path / "b"))
    found = canonical_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert dict(found.dtypes)["pickup_datetime"] == "timestamp_ntz"
    assert found.groupBy("pickup_datetime").count().where("count != 2").isEmpty()
