import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from conftest import plan_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.operators.order_stats import (
    Range,
    Search,
    column_medians,
    digit_counts,
    grouped_median,
    order_statistics,
    ordinal_of,
    row_positions,
    value_of,
    with_ordinal,
)


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(value,) for value in values], f"v {kind}")


def at(spark, values, ranks, kind="double"):
    found = order_statistics(frame(spark, values, kind), "v", lambda n: ranks)
    return [(found.at[rank].value, found.at[rank].below) for rank in ranks]


SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@SLOW
@given(
    st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=60),
    st.integers(0, 1 << 30),
)
def test_any_doubles(spark, values, pick):
    rank = pick % len(values)
    expected = sorted(values)
    value, below = at(spark, values, [rank])[0]
    assert value == expected[rank]
    assert below == sum(1 for v in values if v < value)


@SLOW
@given(st.lists(st.integers(-(1 << 61), 1 << 61), min_size=1, max_size=60))
def test_any_integers(spark, values):
    ranks = sorted({0, len(values) // 2, len(values) - 1})
    found = [value for value, _ in at(spark, values, ranks, "bigint")]
    assert found == [sorted(values)[rank] for rank in ranks]


def test_skew_ties_and_outliers(spark):
    values = [5.0] * 4000 + [float(i) for i in range(3000)] + [1e300, -1e300, 1e-300]
    random.Random(1).shuffle(values)
    ranks = [0, 1, 10, 4000, len(values) - 1]
    expected = sorted(values)
    assert [value for value, _ in at(spark, values, ranks)] == [expected[r] for r in ranks]


def test_missing_values_are_not_ranked(spark):
    df = frame(spark, [None, 3.0, math.nan, 1.0, None])
    found = order_statistics(df, "v", lambda n: [n - 1])
    assert (found.rows, found.at[1].value) == (2, 3.0)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_in_any_session_zone(spark, kind, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        start = datetime(2015, 3, 8)
        texts = [str(start + timedelta(minutes=7 * i, microseconds=i)) for i in range(300)]
        df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
            f"cast(t AS {kind}) AS v", "t"
        )
        found = order_statistics(df, "v", lambda n: [200])
        hit = df.where(df.v == found.literal(200)).collect()
        ordered = df.orderBy("v", "t").collect()
        assert ordered[200].v in [row.v for row in hit]
        assert found.at[200].below == df.where(df.v < found.literal(200)).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_positions_with_a_hot_tie(spark):
    rows = [(1 if i % 3 else i, i) for i in range(900)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "t bigint, id bigint").repartition(5)
    ranks = [0, 5, 200, 450, 899]
    n, positions = row_positions(df, "t", "id", lambda n: ranks)
    assert n == 900
    for rank, position in zip(ranks, positions, strict=True):
        rest = df.where(position.starts_at("t", "id"))
        assert rest.count() == 900 - rank


def test_column_medians(spark):
    df = spark.createDataFrame(
        [(1.0, 7, None), (2.0, 9, None), (4.0, None, None), (10.0, 9, None)],
        "a double, b int, c double",
    )
    assert column_medians(df, ["a", "b", "c"]) == {"a": 3.0, "b": 9.0, "c": None}


@SLOW
@given(st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=80))
def test_ordinals_are_the_bits_in_order(spark, values):
    edges = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308]
    edges += [2.0**k for k in range(-1074, 1024, 97)] + [math.nextafter(2.0**k, 0) for k in (-1022, 0, 1, 52, 1023)]
    rows = with_ordinal(frame(spark, values + edges).withColumnRenamed("v", "_axis"), T.DoubleType())
    for row in rows.collect():
        assert row._ordinal == ordinal_of(row._axis, T.DoubleType())
        assert value_of(row._ordinal, T.DoubleType()) == row._axis


def test_medians_of_groups_have_no_sort_and_no_window(spark, tmp_path):
    path = str(tmp_path / "groups")
    rows = spark.range(4000).selectExpr("id % 3 AS k", "cast(id * 7 % 1000 AS double) / 3 AS v")
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    expected = sorted(map(tuple, rows.groupBy("k").agg(F.median("v")).collect()))
    for group_rows in (100, 10_000):
        result = grouped_median(stored, ["k"], "v", group_rows=group_rows)
        plan = plan_of(result)
        assert "Window" not in plan and "Sort " not in plan
        assert sorted(map(tuple, result.collect())) == [pytest.approx(r) for r in expected]


@pytest.mark.parametrize("group_rows", [0, 50, 10**9])
def test_grouped_median(spark, group_rows):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.expovariate(1)) for i in range(700)]
    rows += [("odd", 2.0), ("odd", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    found = {r.k: r.median for r in grouped_median(df, ["k"], "v", group_rows=group_rows).collect()}
    groups = {}
    for key, value in rows:
        if key is not None:
            groups.setdefault(key, []).extend([] if value is None else [value])
    assert set(found) == set(groups)
    for key, values in groups.items():
        expected = statistics.median(values) if values else None
        assert found[key] == (pytest.approx(expected) if values else None), key


def test_small_groups_need_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id % 5 AS k", "cast(id AS double) AS v").write.parquet(path)
    result = grouped_median(spark.read.parquet(path), ["k"], "v")
    assert plan_of(result).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("shape", ["pareto", "decades", "signs", "uniform"])
def test_passes_do_not_depend_on_the_distribution(spark, monkeypatch, shape):
    from fareline.operators import order_stats

    draw = F.rand(7) * (1 - 1e-9) + 1e-12
    value = {
        "pareto": F.pow(draw, -5.0),
        "decades": F.pow(F.lit(10.0), draw * 300 - 150),
        "signs": F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0) * F.pow(draw, -5.0),
        "uniform": draw,
    }[shape]
    rows = spark.range(300_000, numPartitions=4).select(value.alias("x")).cache()
    calls = []
    histogram = order_stats.histogram
    monkeypatch.setattr(
        order_stats, "histogram", lambda *given: calls.append(1) or histogram(*given)
    )
    found = order_stats.order_statistics(rows, "x", lambda n: [n // 2, n * 9 // 10])
    ordered = sorted(r.x for r in rows.collect())
    assert [found.at[k].value for k in (150_000, 270_000)] == [ordered[150_000], ordered[270_000]]
    assert len(calls) <= 4


@pytest.mark.parametrize("group_rows", [0, 100])
@pytest.mark.parametrize("pair", [(1e308, 1.2e308), (float("-inf"), float("inf")), (2.0, 5.0)])
def test_every_route_has_the_same_median(spark, group_rows, pair):
    rows = spark.createDataFrame([(1, value) for value in pair], "k int, v double")
    found = grouped_median(rows, ["k"], "v", group_rows=group_rows).first()["median"]
    expected = rows.agg(F.median("v")).first()[0]
    searched = column_medians(rows, ["v"])["v"]
    assert found == expected == searched or (found != found and expected != expected and searched != searched)


def test_large_groups_compute_their_rows_a_few_times_only(spark):
    """The passes over large groups read written ordinals, not the rows' own plan."""
    seen = spark.sparkContext.accumulator(0)

    def value(number):
        seen.add(1)
        return float(number)

    counted = F.udf(value, "double").asNondeterministic()
    rows = spark.range(1_000).select((F.col("id") % 2).alias("k"), counted("id").alias("v"))
    found = {r.k: r.median for r in grouped_median(rows, ["k"], "v", group_rows=100).collect()}
    assert found == {0: 499.0, 1: 500.0}
    assert seen.value <= 4_000


def test_a_counting_pass_computes_an_ordinal_once(spark):
    """A filter over the computation would repeat it many times for a row."""
    search = Search(T.DoubleType(), [Range((), 0, ordinal_of(9.0, T.DoubleType()), 0, [1])])
    frame = spark.createDataFrame([(0, 0.5), (0, 3.0), (0, 8.0), (0, 99.0)], "_range int, _axis double")
    counts = digit_counts(frame, search)
    assert sum(row["n"] for row in counts.collect()) == 3
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("log2(") <= 1
