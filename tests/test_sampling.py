import hashlib
import json
import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from fareline.operators.profile import (
    file_digest,
    file_fingerprint,
    filter_retention,
    materialise,
    row_count_within,
    table_digest,
)
from fareline.operators.ranking import ranked_by_priority, with_position
from fareline.operators.sampling import budget_sample, nested_samples, priority_sample
from fareline.plans.modelling.split import time_ordered
from fareline.sources.samples import prepare, write_parquet
from fareline.sources.synthetic import synthetic_trips


def order_of(keys, seed=42):
    return sorted(keys, key=lambda key: hashlib.md5(f"{seed}|{key}".encode()).hexdigest())


def test_ranks_are_dense_and_follow_the_priority(spark):
    df = spark.range(3000).withColumnRenamed("id", "key")
    rows = ranked_by_priority(df, key="key").orderBy("row_id").collect()
    assert [row.row_id for row in rows] == list(range(3000))
    assert [row.key for row in rows] == order_of(range(3000))


def test_sample_is_independent_of_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "key")
    one = priority_sample(df.repartition(1), 300, key="key").collect()
    seven = priority_sample(df.repartition(7), 300, key="key").collect()
    assert sorted(one) == sorted(seven)
    assert {row.key for row in one} == set(order_of(range(2000))[:300])
    other = priority_sample(df, 300, seed=7, key="key").collect()
    assert {row.key for row in other} != {row.key for row in one}


def test_nested_samples_are_prefixes(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    rows = nested_samples(df, (100, 300, 600), key="key").collect()
    label = {row.row_id: row.sample for row in rows}
    assert all(label[i] == "small" for i in range(100))
    assert all(label[i] == "medium" for i in range(100, 300))
    assert all(label[i] == "large" for i in range(300, 600))
    assert len(rows) == 600


@pytest.mark.parametrize("sizes", [(200, 100, 300), (100, 100, 200), (1, 2), (0, 1, 2)])
def test_size_guard(spark, sizes):
    with pytest.raises(ValueError):
        nested_samples(spark.range(10), sizes, key="id")


def test_budget_keeps_everything_that_fits(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    assert budget_sample(df, 50).count() == 50
    assert budget_sample(df, 20).count() == 20
    assert budget_sample(df, 20).columns == ["row_id"]
    with pytest.raises(ValueError):
        budget_sample(df, 0)


def test_rows_are_never_ranked_in_one_partition(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    plan = plan_of(ranked_by_priority(df, 100, key="key"))
    facts = plan.split("Exchange SinglePartition")
    # The only single partition holds the bucket sizes, after their aggregation.
    assert len(facts) == 2 and "HashAggregate(keys=[_bucket" in facts[1]
    assert "hashpartitioning(_bucket" in plan and "Python" not in plan


def test_positions_with_a_hot_tie(spark):
    rows = [(0 if i % 3 else i, i) for i in range(2000)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "t bigint, id bigint").repartition(6)
    placed = with_position(df, ["t", "id"]).orderBy("position").collect()
    assert [(row.t, row.id) for row in placed] == sorted(rows)
    assert [row.position for row in placed] == list(range(2000))


def test_time_order_settles_ties_by_key(spark):
    trips = synthetic_trips(spark, 300).withColumn(
        "pickup_datetime", F.date_trunc("day", "pickup_datetime")
    )
    rows = time_ordered(trips.repartition(4)).collect()
    keys = [(row.pickup_datetime, row.row_id) for row in rows]
    assert keys == sorted(keys)


def test_synthetic_distribution(spark):
    trips = synthetic_trips(spark, 20_000)
    assert len(trips.columns) == 10 and trips.count() == 20_000
    row = trips.agg(
        F.avg("trip_distance").alias("distance"),
        F.var_pop("trip_distance").alias("distance_var"),
        F.avg(F.col("tip_amt") / F.col("fare_amt")).alias("tip"),
        F.min("passenger_count").alias("low"),
        F.max("passenger_count").alias("high"),
        F.min("start_lon").alias("west"),
        F.max("start_lon").alias("east"),
        F.corr("start_lon", "end_lon").alias("dependence"),
        F.avg("fare_amt").alias("fare"),
    ).first()
    assert row.distance == pytest.approx(3.6, rel=0.03)
    assert row.distance_var == pytest.approx(2 * 1.8**2, rel=0.08)
    assert row.tip == pytest.approx(0.125, rel=0.03)
    assert (row.low, row.high) == (1.0, 6.0)
    assert -74.05 <= row.west < row.east <= -73.8
    assert abs(row.dependence) < 0.03
    assert row.fare == pytest.approx(3 + 2.6 * 3.6 + 2.4, rel=0.03)


def test_synthetic_rows_are_prefixes(spark):
    small = synthetic_trips(spark, 50).collect()
    large = synthetic_trips(spark, 200).repartition(3).where("row_id < 50").collect()
    assert sorted(small) == sorted(large)


def test_prepare_writes_nested_reproducible_samples(spark, tmp_path):
    sizes = (100, 300, 600)
    manifests = [prepare(spark, str(tmp_path / name), sizes=sizes).first() for name in "ab"]
    folders = [str(tmp_path / name) for name in "ab"]
    tables = [spark.read.parquet(f"{folder}/large") for folder in folders]
    frames = [table.orderBy("row_id").collect() for table in tables]
    assert frames[0] == frames[1]
    small = spark.read.parquet(f"{folders[0]}/small").orderBy("row_id").collect()
    assert small == frames[0][:100]
    assert [entry.rows for entry in manifests[0].datasets] == list(sizes)
    assert manifests[0].coordinates_available and manifests[0].origin.kind == "synthetic"
    written = spark.read.json(f"{folders[0]}/manifest").first()
    assert json.loads(json.dumps(written.datasets[0].asDict()))["label"] == "small"


def test_prepare_samples_raw_files(spark, tmp_path):
    raw = spark.range(900).selectExpr(
        "timestamp_ntz'2015-01-01' + make_dt_interval(0, 0, cast(id AS int)) tpep_pickup_datetime",
        "cast(id AS string) AS fare_amount",
        "id / 100 AS tip_amount",
        "1 + id % 6 AS passenger_count",
        "id AS trip_distance",
        "id % 50 AS PULocationID",
        "'x' AS other",
    )
    raw.repartition(4).write.parquet(str(tmp_path / "raw"))
    output = str(tmp_path / "out")
    manifest = prepare(spark, output, [str(tmp_path / "raw")], (100, 200, 300)).first()
    large = spark.read.parquet(f"{output}/large")
    assert sorted(row.row_id for row in large.collect()) == list(range(300))
    assert large.select("fare_amt").distinct().count() == 300
    assert "other" not in large.columns and "row_key" not in large.columns
    assert manifest.origin.source_rows == 900 and not manifest.coordinates_available
    with pytest.raises(ValueError, match="fewer"):
        prepare(spark, str(tmp_path / "more"), [str(tmp_path / "raw")], (100, 200, 1000))


def test_existing_output_is_refused(spark, tmp_path):
    path = str(tmp_path / "out")
    write_parquet(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_parquet(spark.range(3), path)


def test_files_hold_at_most_the_given_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    write_parquet(spark.range(100).coalesce(1), path, file_rows=30)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sorted(row["count"] for row in sizes) == [10, 30, 30, 30]


def test_fingerprints_match_the_file_content(spark, tmp_path):
    contents = {
        "a.bin": b"x",
        "b c.bin": b"trips" * 1000,
        "c.bin": bytes(range(256)) * 9000,
        "empty.bin": b"",
    }
    folder = tmp_path / "with space"
    folder.mkdir()
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    found = file_fingerprint(spark, str(folder)).collect()
    assert {row.path.rsplit("/", 1)[1].replace("%20", " "): (row.bytes, row.sha256) for row in found} == {
        name: (len(content), hashlib.sha256(content).hexdigest())
        for name, content in contents.items()
    }
    plan = file_fingerprint(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_fingerprint_of_a_file_of_many_blocks(spark, tmp_path):
    folder = tmp_path / "large files"
    folder.mkdir()
    block, digest = bytes(range(256)) * 4096 * 16 + b"odd", hashlib.sha256()
    with (folder / "a large.bin").open("wb") as out:
        for _ in range(5):
            out.write(block)
            digest.update(block)
    # No file is a value: one above the largest length that Spark lets a value have is digested too.
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 1024**2)
    try:
        row = file_fingerprint(spark, str(folder)).first()
    finally:
        spark.conf.unset(limit)
    assert (row.bytes, row.sha256) == (5 * len(block), digest.hexdigest())


def test_hidden_files_are_no_part_of_a_table(spark, tmp_path):
    """A folder that Spark wrote holds _SUCCESS; its one part alone is the table."""
    path = tmp_path / "table"
    spark.range(10).coalesce(1).write.parquet(str(path))
    part = next(path.glob("part-*.parquet"))
    assert [row.file for row in file_fingerprint(spark, str(path)).collect()] == [part.name]
    row = table_digest(file_fingerprint(spark, str(path))).first()
    assert row.sha256 == hashlib.sha256(part.read_bytes()).hexdigest()


def test_digests_use_the_sessions_file_system_settings(spark, tmp_path):
    """A file system that only this session names is opened in the tasks."""
    (tmp_path / "a.bin").write_bytes(b"abc")
    name = "fs.odd.impl"
    spark.conf.set(name, "org.apache.hadoop.fs.RawLocalFileSystem")
    try:
        digest = file_digest(spark)
        row = spark.range(1).select(F.call_udf(digest, F.lit(f"odd://{tmp_path}/a.bin")).alias("sha256"))
        with pytest.raises(Exception, match="Wrong FS"):
            row.collect()
    finally:
        spark.conf.unset(name)


def test_digest_of_a_table(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.bin").write_bytes(b"abc")
    row = table_digest(file_fingerprint(spark, str(tmp_path / "one"))).first()
    assert (row.bytes, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    (tmp_path / "one" / "b.bin").write_bytes(b"d")
    parts = sorted(hashlib.sha256(x).hexdigest() for x in (b"abc", b"d"))
    row = table_digest(file_fingerprint(spark, str(tmp_path / "one"))).first()
    assert row.sha256 == hashlib.sha256(",".join(parts).encode()).hexdigest()


def test_retention_of_an_empty_table(spark):
    row = filter_retention(spark.range(0), F.col("id") > 3).first()
    assert (row.kept, row.rows, row.retention) == (0, 0, None)


def test_row_limit_is_optional(spark):
    df = spark.range(10)
    materialise(df)
    assert row_count_within(df) == row_count_within(df, 10) == 10
    with pytest.raises(ValueError):
        row_count_within(df, 9)
