"""Physical plans and the places where state may live."""

import os
from types import SimpleNamespace
from urllib.parse import unquote

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fareline.operators.sampling import priority_sample
from fareline.plans.modelling.features import encoded_zones, fit_zone
from fareline.plans.modelling.split import chronological_split, expanding_folds
from fareline.session import remove, scratch, settled, shared_folder, written
from fareline.sources.synthetic import synthetic_trips


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "trips")
    synthetic_trips(spark, 500).write.parquet(path)
    return spark.read.parquet(path)


def test_split_boundary_reaches_the_scan(stored):
    split = chronological_split(stored)
    train, test = plan_of(split.train.select("fare_amt")), plan_of(split.test.select("fare_amt"))
    assert "LessThan(pickup_datetime," in train and "GreaterThanOrEqual(pickup_datetime," in test
    assert "ReadSchema: struct<pickup_datetime:timestamp_ntz,fare_amt:double>" in train
    assert "Exchange" not in train and "Sort" not in train


def test_fold_membership_needs_no_shuffle(stored):
    plan = plan_of(expanding_folds(stored))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_sample_scans_the_key_alone_for_the_bucket_sizes(stored):
    plan = plan_of(priority_sample(stored, 50))
    assert "ReadSchema: struct<row_id:bigint>" in plan
    assert "BroadcastHashJoin" in plan and "isnotnull(coalesce" not in plan


def test_small_category_table_is_part_of_the_plan(stored):
    zoned = stored.withColumn("pickup_zone", F.col("passenger_count"))
    plan = plan_of(encoded_zones(zoned, [fit_zone(zoned, "pickup_zone")]))
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan


def test_large_category_table_is_written_and_joined_without_a_hint(spark, stored, monkeypatch):
    monkeypatch.setattr("fareline.session.small_table", lambda df: None)
    zoned = stored.withColumn("pickup_zone", F.col("passenger_count"))
    coding = fit_zone(zoned, "pickup_zone")
    encoded = encoded_zones(zoned, [coding])
    assert "strategy=broadcast" not in encoded._jdf.queryExecution().toString()
    assert encoded.count() == 500
    assert encoded.where("label IS NULL").count() == 0


def test_settled_tables_hold_the_same_rows(spark, monkeypatch):
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    local = settled(df, "t").collect()
    monkeypatch.setattr("fareline.session.small_table", lambda df: None)
    assert sorted(settled(df, "t").collect()) == sorted(local)


def test_written_tables_are_read_back_from_the_shared_folder(spark):
    table = written(spark.range(5), "numbers")
    assert table.count() == 5
    assert all(shared_folder(spark) in name for name in table.inputFiles())


def test_scratch_tables_are_deleted(spark):
    kept = written(spark.range(3), "kept")
    with scratch(spark):
        inner = written(spark.range(4), "inner")
        files = inner.inputFiles()
        assert inner.count() == 4
    assert kept.count() == 3
    assert not any(os.path.exists(unquote(f.removeprefix("file://"))) for f in files)
    with pytest.raises(ValueError, match="not a table"):
        remove(spark, "/etc")


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


def test_the_given_folder_is_used():
    conf = SimpleNamespace(get=lambda name, default: "hdfs:///shared/")
    assert shared_folder(SimpleNamespace(conf=conf)) == "hdfs:///shared"
