import math
import re

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fareline.operators.workload import (
    OPERATIONS,
    fare_value_counts,
    filter_tips,
    lookup_dimension,
    operation,
    passenger_stats,
    row_id_join,
)
from fareline.plans.pandas_surface import indexed, pandas_lookup, pandas_operation
from fareline.plans.workload import (
    MODES,
    fused_pass,
    mode_input,
    run_workload,
    workload_results,
)
from fareline.session import cached, localised
from fareline.sources.synthetic import synthetic_trips

SCHEMA = "row_id bigint, fare_amt double, tip_amt double, passenger_count double"
STATS = ["fare_amt_mean", "fare_amt_std", "tip_amt_mean", "tip_amt_std"]


@pytest.fixture(scope="module")
def trips(spark):
    return synthetic_trips(spark, 500).cache()


@pytest.fixture(scope="module")
def local(trips):
    return trips.toPandas().set_index("row_id").sort_index()


def angle(frame):
    """The angular value by the half-angle identity sin(x/2)^2 = (1 - cos x) / 2, row by row."""

    def one(trip):
        def gap(name):
            return math.radians(trip[f"end_{name}"] - trip[f"start_{name}"])

        ends = [math.cos(math.radians(trip[name])) for name in ("start_lon", "end_lon")]
        share = (1 - math.cos(gap("lon")) + math.prod(ends) * (1 - math.cos(gap("lat")))) / 2
        return math.acos(1 - 2 * share)

    return frame.apply(one, axis=1)


def test_angular_value_by_hand(spark):
    """Values worked out on paper: equal ends, a quarter turn east, and one north on longitude 0."""
    rows = [(0, 0.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 90.0, 0.0), (2, 0.0, 0.0, 0.0, 60.0)]
    names = "row_id long, start_lon double, start_lat double, end_lon double, end_lat double"
    trips = spark.createDataFrame(rows, names)
    found = {r.row_id: r.value for r in operation(trips, "complex").collect()}
    assert found == pytest.approx({0: 0.0, 1: math.pi / 2, 2: math.pi / 3})


def test_scalars_match_pandas(trips, local):
    expected = {
        "count": len(local),
        "count_index": len(local.index),
        "mean": local.fare_amt.mean(),
        "std": local.fare_amt.std(ddof=1),
        "mean_sum": (local.fare_amt + local.tip_amt).mean(),
        "mean_product": (local.fare_amt * local.tip_amt).mean(),
        "mean_complex": angle(local).mean(),
        "join_count": 6,
    }
    for name, value in expected.items():
        assert operation(trips, name).first()["value"] == pytest.approx(value, rel=1e-9), name


def test_row_values_match_pandas(trips, local):
    expected = {
        "sum_columns": local.fare_amt + local.tip_amt,
        "product_columns": local.fare_amt * local.tip_amt,
        "complex": angle(local),
    }
    for name, series in expected.items():
        actual = operation(trips, name).toPandas().set_index("row_id").value.sort_index()
        np.testing.assert_allclose(actual, series, rtol=1e-6, atol=1e-11, err_msg=name)


def test_tables_match_pandas(trips, local):
    counts = operation(trips, "value_counts").toPandas().set_index("fare_amt").n.sort_index()
    assert counts.to_dict() == local.fare_amt.value_counts().to_dict()
    stats = operation(trips, "groupby").toPandas().set_index("passenger_count").sort_index()
    grouped = local.groupby("passenger_count")[["fare_amt", "tip_amt"]].agg(["mean", "std"])
    np.testing.assert_allclose(stats, grouped, rtol=1e-9)
    joined = operation(trips, "join").toPandas().set_index("row_id").sort_index()
    assert list(joined.index) == [1, 2, 3, 4, 5, 6]
    np.testing.assert_allclose(joined[STATS], grouped.loc[joined.index.astype(float)])
    assert set(local.columns) < set(joined.columns)


def test_every_operation_runs_in_every_mode(trips):
    for mode in MODES:
        with mode_input(trips, mode) as frame:
            plans = run_workload(frame)
            assert list(plans) == list(OPERATIONS)
            assert all(plan.count() >= 1 for plan in plans.values())


def test_null_keys_are_dropped(spark):
    rows = [(0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0), (2, 3.0, 1.0, None), (3, None, 2.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {row.fare_amt: row.n for row in fare_value_counts(df).collect()} == {1.0: 1, 3.0: 1}
    assert [row.passenger_count for row in passenger_stats(df).collect()] == [1.0]


def test_single_row_group_has_no_deviation(spark):
    row = passenger_stats(spark.createDataFrame([(0, 5.0, 1.0, 2.0)], SCHEMA)).first()
    assert (row.fare_amt_mean, row.fare_amt_std) == (5.0, None)


def test_empty_input(spark):
    df = spark.createDataFrame([(0, 5.0, 9.0, 2.0)], SCHEMA)
    empty = filter_tips(df)
    assert operation(empty, "count").first()["value"] == 0
    assert operation(empty, "mean").first()["value"] is None
    assert operation(empty, "join_count").first()["value"] == 0
    assert operation(empty, "join").count() == 0


def test_filter_is_inclusive(spark):
    rows = [(i, 1.0, tip, 1.0) for i, tip in enumerate([0.99, 1.0, 3.0, 5.0, 5.01, None])]
    kept = filter_tips(spark.createDataFrame(rows, SCHEMA))
    assert sorted(row.row_id for row in kept.collect()) == [1, 2, 3]


def test_angle_without_coordinate_is_missing(spark):
    columns = "row_id bigint, start_lon double, start_lat double, end_lon double, end_lat double"
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0), (1, None, 2.0, 3.0, 4.0)], columns)
    values = {row.row_id: row.value for row in operation(df, "complex").collect()}
    assert math.isfinite(values[0]) and values[1] is None
    assert operation(df, "mean_complex").first()["value"] == pytest.approx(values[0])


def test_fractional_lookup_keys_never_match(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 1.5), (2, 2.0, 1.0, 2.0)], SCHEMA)
    assert [row.row_id for row in operation(df, "join").collect()] == [2]


def test_large_lookup_joins_by_shuffle(spark, monkeypatch):
    ids = spark.range(300)
    lookup = ids.select(F.col("id").cast("double").alias("passenger_count"), F.lit(1.0).alias("m"))
    monkeypatch.setattr("fareline.operators.workload.small_table", lambda df: None)
    joined = row_id_join(ids.withColumnRenamed("id", "row_id"), lookup)
    assert "rightHint=(strategy=broadcast)" not in joined._jdf.queryExecution().toString()
    assert joined.count() == 300


def test_localised_stops_at_the_limit(spark):
    df = spark.range(10)
    assert localised(df, 9) is df
    assert localised(df, 10).count() == 10


def test_lookup_is_rebuilt_per_mode(trips):
    whole = lookup_dimension(trips).agg(F.avg("fare_amt_mean")).first()[0]
    kept = lookup_dimension(filter_tips(trips)).agg(F.avg("fare_amt_mean")).first()[0]
    values = {}
    for mode in MODES:
        rows = workload_results(trips, mode).collect()
        values[mode] = {row.operation: (row.rows, row.value) for row in rows}
    assert set(values["standard"]) == set(OPERATIONS)
    assert values["standard"]["groupby"][1] == pytest.approx(whole)
    assert values["filtered"]["groupby"][1] == pytest.approx(kept)
    for name, (rows, value) in values["filtered"].items():
        assert values["filtered_cached"][name] == (rows, pytest.approx(value)), name


def test_cache_is_released(spark):
    df = spark.range(100).withColumn("x", F.rand(1))
    with cached(df) as kept:
        assert kept.storageLevel.useMemory
        assert "InMemoryTableScan" in plan_of(kept.select("x"))
    assert not kept.storageLevel.useMemory


def test_results_do_not_depend_on_partitioning(trips):
    def digest(df):
        rows = workload_results(df, "filtered").collect()
        return {r.operation: (r.rows, round(r.value, 9)) for r in rows}

    assert digest(trips.repartition(1)) == digest(trips.repartition(7))


def test_plans_do_not_run_anything(spark, trips):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "construct only")
    frame = filter_tips(trips)
    for name in OPERATIONS:
        if not name.startswith("join"):
            operation(frame, name)
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "trips")
    synthetic_trips(spark, 200).write.parquet(path)
    plan = plan_of(passenger_stats(filter_tips(spark.read.parquet(path))))
    assert "GreaterThanOrEqual(tip_amt,1.0)" in plan and "LessThanOrEqual(tip_amt,5.0)" in plan
    assert "ReadSchema: struct<fare_amt:double,tip_amt:double,passenger_count:double>" in plan
    assert "partial_avg" in plan and "Python" not in plan


def test_join_reads_only_rows_that_can_match(spark, tmp_path):
    path = str(tmp_path / "trips")
    synthetic_trips(spark, 200).write.parquet(path)
    plan = plan_of(operation(spark.read.parquet(path), "join_count"))
    assert "BroadcastHashJoin" in plan and "Python" not in plan.replace("PythonRDD", "")
    assert "GreaterThanOrEqual(row_id,1)" in plan and "LessThanOrEqual(row_id,6)" in plan
    assert "ReadSchema: struct<row_id:bigint>" in plan


def test_pandas_surface_matches(trips, local):
    frame = indexed(trips)
    lookup = pandas_lookup(frame)
    for name in ("count", "count_index", "mean", "std", "mean_sum", "mean_product"):
        expected = operation(trips, name).first()["value"]
        assert pandas_operation(frame, name, lookup) == pytest.approx(expected), name
    assert pandas_operation(frame, "join_count", lookup) == 6
    assert len(pandas_operation(frame, "join", lookup)) == 6
    assert pandas_operation(frame, "mean_complex") == pytest.approx(angle(local).mean())
    values = pandas_operation(frame, "complex").to_pandas().sort_index()
    np.testing.assert_allclose(values, angle(local), rtol=1e-6, atol=1e-11)
    total = pandas_operation(frame, "sum_columns").to_pandas().sort_index()
    np.testing.assert_allclose(total, local.fare_amt + local.tip_amt)
    counts = pandas_operation(frame, "value_counts").to_pandas()
    assert counts.to_dict() == local.fare_amt.value_counts().to_dict()
    grouped = pandas_operation(frame, "groupby").to_pandas().sort_index()
    assert list(grouped.columns) == STATS
    assert isinstance(grouped, pd.DataFrame) and len(grouped) == 6


def test_a_mode_reads_its_input_once_and_the_join_rows(spark, tmp_path):
    path = str(tmp_path / "trips")
    synthetic_trips(spark, 300).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = plan_of(fused_pass(filter_tips(stored)))
    assert plan.count("FileScan parquet") == 1 and "GreaterThanOrEqual(tip_amt,1.0)" in plan
    rest = plan_of(workload_results(stored, "filtered"))
    assert rest.count("FileScan parquet") == 1
    assert re.search(r"row_id#\d+L >= 1\)", rest) and re.search(r"row_id#\d+L <= 6\)", rest)


def test_fused_measures_equal_the_single_operations(spark):
    """Missing values, equal fares, and a mean far from 0 for the spread."""
    rows = [(i, 1e6 + i % 7 if i % 5 else None, 1.0 + i % 3, None if i % 11 == 0 else float(i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, fare_amt double, tip_amt double, passenger_count double")
    found = {r.operation: (r.rows, r.value) for r in workload_results(df, "standard").collect()}
    assert set(found) == set(OPERATIONS) - {"complex", "mean_complex"}
    for name in ("count", "count_index", "mean", "std", "mean_sum", "mean_product", "join_count"):
        assert found[name][1] == pytest.approx(operation(df, name).first()["value"], rel=1e-12), name
    for name in ("sum_columns", "product_columns"):
        row = operation(df, name).agg(F.count("*"), F.avg("value")).first()
        assert found[name] == (row[0], pytest.approx(row[1])), name
    counts = operation(df, "value_counts").agg(F.count("*"), F.avg("n")).first()
    assert found["value_counts"] == tuple(counts)


def test_an_empty_input_has_a_digest(spark):
    df = spark.createDataFrame([], "row_id bigint, fare_amt double, tip_amt double, passenger_count double")
    found = {r.operation: (r.rows, r.value) for r in workload_results(df, "standard").collect()}
    assert found["count"] == (1, 0.0) and found["mean"] == (1, None) and found["value_counts"] == (0, None)
