import math

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fareline.operators.compare import assert_matches, tolerant_diff, tolerant_diff_of_unique
from fareline.sources.synthetic import synthetic_trips

SCHEMA = "id bigint, v double"


def reasons(spark, actual, expected, schema=SCHEMA, **tolerance):
    a, b = spark.createDataFrame(actual, schema), spark.createDataFrame(expected, schema)
    found = tolerant_diff(a, b, ["id"], **tolerance).collect()
    return {(row.id, row.column): row.reason for row in found}


def test_every_kind_of_difference(spark):
    actual = [(1, 1.0), (2, None), (3, None), (4, 1.0), (5, 1.0), (6, 1.0), (8, 1.0), (8, 1.0)]
    expected = [(1, 1.000001), (2, None), (3, 1.0), (4, None), (5, 1.1), (7, 1.0), (8, 1.0)]
    assert reasons(spark, actual, expected) == {
        (3, "v"): "null",
        (4, "v"): "null",
        (5, "v"): "value",
        (6, None): "extra",
        (7, None): "missing",
        (8, None): "duplicate",
    }


def test_nan_counts_as_missing_and_infinity_equals_itself(spark):
    actual = [(1, math.nan), (2, math.inf), (3, math.inf), (None, 1.0)]
    expected = [(1, None), (2, math.inf), (3, 1.0), (None, 1.0)]
    assert reasons(spark, actual, expected) == {(3, "v"): "value"}


def test_tolerance_is_relative_to_the_expected_value(spark):
    assert reasons(spark, [(1, 111.0)], [(1, 100.0)], rtol=0.1) == {(1, "v"): "value"}
    assert reasons(spark, [(1, 110.0)], [(1, 100.0)], rtol=0.1) == {}


def test_other_types_compare_exactly(spark):
    schema = "id bigint, name string, day date"
    found = spark.sql("SELECT 1L AS id, 'a' AS name, date'2015-01-01' AS day")
    other = spark.sql("SELECT 1L AS id, 'b' AS name, date'2015-01-02' AS day")
    assert tolerant_diff(found, found, ["id"]).count() == 0
    rows = tolerant_diff(found, other, ["id"]).collect()
    assert {(row.column, row.reason, row.actual) for row in rows} == {
        ("name", "value", None),
        ("day", "value", None),
    }
    assert schema


def test_numeric_types_are_interchangeable(spark):
    whole = spark.sql("SELECT 1 AS id, 5 AS v")
    double = spark.sql("SELECT 1L AS id, 5.0D AS v")
    assert tolerant_diff(whole, double, ["id"]).count() == 0


def test_table_equals_itself(spark):
    trips = synthetic_trips(spark, 300)
    assert_matches(trips.repartition(3), trips, ["row_id"])


def test_gate_fails_on_wrong_results(spark):
    right = spark.createDataFrame([(0, 12.0)], SCHEMA)
    wrong = spark.createDataFrame([(0, 13.0)], SCHEMA)
    with pytest.raises(AssertionError, match="tables differ"):
        assert_matches(wrong, right, ["id"])
    with pytest.raises(AssertionError, match="columns differ"):
        assert_matches(wrong.withColumnRenamed("v", "w"), right, ["id"])


def test_hot_key_stays_one_row_and_one_shuffle(spark):
    hot = spark.range(5000).select(F.lit(1).alias("id"), F.col("id").cast("double").alias("v"))
    found = tolerant_diff(hot, hot, ["id"])
    assert [row.reason for row in found.collect()] == ["duplicate"]
    plan = plan_of(found)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2
    assert "partial_first" in plan


@pytest.mark.parametrize(
    "actual, expected, same",
    [
        (5.0, float("inf"), False),
        (float("inf"), 5.0, False),
        (float("-inf"), float("inf"), False),
        (float("inf"), float("inf"), True),
        (float("-inf"), float("-inf"), True),
        (float("nan"), float("nan"), True),
        (float("nan"), float("inf"), False),
        (1.0, 1.0 + 1e-7, True),
    ],
)
def test_infinities_are_close_to_themselves_only(spark, actual, expected, same):
    sides = [spark.createDataFrame([(1, value)], "k int, v double") for value in (actual, expected)]
    assert tolerant_diff(*sides, ["k"]).isEmpty() is same


def test_equal_tables_move_only_checksums(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id AS k", "id / 7 AS v", "cast(id % 9 AS string) AS t")
    rows.write.parquet(str(tmp_path / "a"))
    rows.repartition(5).write.parquet(str(tmp_path / "b"))
    sides = [spark.read.parquet(str(tmp_path / name)) for name in "ab"]
    found = tolerant_diff_of_unique(*sides, ["k"])
    assert "FileScan" not in plan_of(found) and found.collect() == []


def test_differences_of_unique_keys_are_the_same(spark):
    """Values beyond and within the tolerance, missing rows, missing values, both zeros, NaN."""
    def value(k, shift):
        special = {0: math.nan, 1: None, 2: 0.0 if shift else -0.0, 3: math.inf}
        return special.get(k % 11, k / 3 * (1 + shift * (1e-3 if k % 50 == 4 else 1e-9)))

    sides = [
        spark.createDataFrame(
            [(k, value(k, shift), f"t{k + shift * (k % 97 == 5)}") for k in range(3000) if k % 101 != 7 + shift],
            "k long, v double, t string",
        )
        for shift in (0, 1)
    ]
    whole = sorted(map(tuple, tolerant_diff(*sides, ["k"]).collect()), key=str)
    assert whole and whole == sorted(map(tuple, tolerant_diff_of_unique(*sides, ["k"]).collect()), key=str)
    empty = sides[0].limit(0)
    assert tolerant_diff_of_unique(sides[0], empty, ["k"]).count() == sides[0].count()
    assert tolerant_diff_of_unique(empty, empty, ["k"]).count() == 0
