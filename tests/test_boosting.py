import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fareline.plans.modelling import boosting, models
from fareline.plans.modelling.boosting import Bins, Search, Shipped, blocks_of, fit_tables, fit_thresholds, fit_trees
from fareline.plans.modelling.models import band_task, fare_task, fit_fare_models, fold_scores
from fareline.plans.modelling.split import ml_frame
from fareline.sources.synthetic import synthetic_trips


def rows_of(spark, rows=600, zones=40):
    """Vectors of three numbers (one with few values) and a one-hot zone."""
    draw = np.random.default_rng(5)
    found = []
    for _ in range(rows):
        numbers, zone = [draw.normal(), float(draw.integers(0, 4)), draw.exponential()], int(draw.integers(0, zones))
        label = 3 * numbers[0] + numbers[1] ** 2 + (zone % 7) + draw.normal()
        sparse = {k: v for k, v in enumerate(numbers) if v} | {3 + zone: 1.0}
        found.append((float(label), Vectors.sparse(3 + zones, sparse)))
    return spark.createDataFrame(found, ["fare_amt", "features"]).repartition(3).cache()


def test_trees_equal_those_of_spark_ml(spark):
    rows = rows_of(spark)
    settings = [(3, 0.15), (5, 0.3)]
    for (depth, rate), model in zip(settings, fit_trees(rows, "fare_amt", settings, 12, "ours"), strict=True):
        other = GBTRegressor(labelCol="fare_amt", predictionCol="theirs", maxIter=12, maxDepth=depth, stepSize=rate)
        both = model.transform(other.fit(rows).transform(rows))
        assert both.agg(F.max(F.abs(F.col("ours") - F.col("theirs")))).first()[0] < 1e-9


def test_dense_vectors_give_the_same_trees(spark):
    sparse = rows_of(spark, 200, 5)
    dense = F.udf(lambda v: Vectors.dense(v.toArray()), sparse.schema["features"].dataType)
    frames = sparse, sparse.withColumn("features", dense("features"))
    a, b = (fit_trees(frame, "fare_amt", [(3, 0.1)], 4, "p")[0].transform(frame) for frame in frames)
    assert sorted(r.p for r in a.collect()) == pytest.approx(sorted(r.p for r in b.collect()))


def test_thresholds_count_all_rows_of_many_values(spark, monkeypatch):
    """Values beyond the limit are counted in cells: every row counts, the strides stay near equal."""
    monkeypatch.setattr(boosting, "MAX_VALUES", 500)
    draw = np.random.default_rng(1).random(4_000)
    frame = spark.createDataFrame([(Vectors.dense([float(x), 1.0]),) for x in draw], ["features"])
    found = fit_thresholds(frame.select(F.unwrap_udt("features").alias("vector")), 4_000)
    assert list(found) == [0]
    np.testing.assert_allclose(found[0], np.quantile(draw, np.arange(1, 32) / 32), atol=0.005)


def test_a_search_takes_few_jobs(spark):
    """All settings of a fold grow in the same jobs, one for each level of a round."""
    split = ml_frame(synthetic_trips(spark, 1_000).cache(), stage="completed-trip")
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("search", "search")
    try:
        scores = fold_scores(split, [fare_task(rounds=4), band_task({"C": (1.0,)})])
    finally:
        context._jsc.clearJobGroup()
    assert len(scores) == 15
    assert len(tracker.getJobIdsForGroup("search")) < 600


def test_the_first_of_equal_features_is_taken(spark):
    """A feature and its mirror image divide the rows alike; the order of sums must not decide."""
    random = np.random.default_rng(3)
    draw = zip(random.integers(1, 20, 300).astype(float), random.normal(size=300), strict=True)
    rows = [(float(np.sin(5 * x) * 1e3 + noise), Vectors.dense([-x, x, 30 - x])) for x, noise in draw]
    frame = spark.createDataFrame(rows, ["fare_amt", "features"]).repartition(3).cache()
    model = fit_trees(frame, "fare_amt", [(4, 0.3)], 6, "p")[0]
    assert {int(name) for names in model.features for name in names if name >= 0} == {0}


def test_tables_grow_in_the_jobs_of_one(spark):
    """The folds of a search share their jobs, and have the trees they have alone."""
    tables, settings = [rows_of(spark, 200, 5), rows_of(spark, 500, 40)], [(2, 0.3), (3, 0.1)]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs = []
    found = []
    for number, group in enumerate(([tables[0]], [tables[1]], tables)):
        context.setJobGroup(f"tables{number}", "tables")
        try:
            found += fit_tables(group, "fare_amt", settings, 10, "p")
        finally:
            context._jsc.clearJobGroup()
        jobs.append(len(tracker.getJobIdsForGroup(f"tables{number}")))
    assert jobs[2] < sum(jobs[:2]) - 25
    for alone, together in zip(found[:2], found[2:], strict=True):
        for one, other in zip(alone, together, strict=True):
            for a, b in zip(one.features + one.thresholds, other.features + other.thresholds, strict=True):
                np.testing.assert_array_equal(a, b)
            np.testing.assert_allclose(np.concatenate(one.values), np.concatenate(other.values), rtol=1e-9, atol=1e-12)


def test_the_refit_grows_with_the_folds_while_cores_are_left(spark, monkeypatch):
    split = ml_frame(synthetic_trips(spark, 1_000).cache(), stage="pickup")
    grids = {"max_depth": (2, 3), "learning_rate": (0.1,)}, {"C": (1.0,)}
    tables, predictions = [], []
    whole = models.fit_fares
    monkeypatch.setattr(models, "fit_fares", lambda t, *rest: tables.append(len(t)) or whole(t, *rest))
    for waves in (100, 0):
        monkeypatch.setattr(models, "WAVES", waves)
        found = fit_fare_models(split, 4, *grids)
        predictions.append(found.predictions.orderBy("row_id").toPandas()["predicted_fare"])
    assert tables == [4, 3, 1]
    np.testing.assert_allclose(*predictions, rtol=1e-9)


def test_tables_of_one_partition_need_no_shuffle(spark):
    """The sums of a table that lies in one partition are complete: a level is one stage."""
    rows = [rows_of(spark, 200, 5).collect(), rows_of(spark, 300, 9).collect()]
    tables, settings = [spark.createDataFrame(some).coalesce(1) for some in rows], [(2, 0.3)]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("whole", "whole")
    try:
        found = fit_tables(tables, "fare_amt", settings, 3, "p")
    finally:
        context._jsc.clearJobGroup()
    jobs = sorted(tracker.getJobIdsForGroup("whole"))[-6:]
    assert [len(tracker.getJobInfo(job).stageIds) for job in jobs] == [1] * 6
    for table, models_of in zip(tables, found, strict=True):
        (spread,) = fit_trees(table.repartition(3), "fare_amt", settings, 3, "p")
        for a, b in zip(spread.thresholds, models_of[0].thresholds, strict=True):
            np.testing.assert_array_equal(a, b)


def test_a_task_has_one_block_of_its_batches(spark, monkeypatch):
    """Sums are merged by block, so a task's batches are one block; large ones are several."""
    vectors = rows_of(spark).select(F.unwrap_udt("features").alias("vector"), F.col("fare_amt").alias("label"))
    shared = spark.sparkContext.broadcast(Shipped(Search([Bins.of(fit_thresholds(vectors, 600), 43)], [3])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        blocks = blocks_of(vectors, shared, 0, 1).map(lambda block: (len(block[5]), list(block[1]))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(rows for rows, _ in blocks) == 600
    # The numbers have columns, zones have none.
    assert [names for _, names in blocks] == [[0, 1, 2]] * 3


def test_rows_without_a_number_stay_in_its_column(spark):
    """A number that most rows store, one that few store, and its zeros: the trees of Spark ML."""
    draw = np.random.default_rng(8)
    found = []
    for _ in range(500):
        common = draw.normal() if draw.random() < 0.7 else 0.0
        rare = draw.normal() if draw.random() < 0.2 else 0.0
        numbers = {k: v for k, v in enumerate([common, rare]) if v}
        found.append((float(np.sign(common) + 2 * (rare > 0.3) + common * rare + draw.normal() / 9), Vectors.sparse(2, numbers)))
    rows = spark.createDataFrame(found, ["fare_amt", "features"]).repartition(2).cache()
    model = fit_trees(rows, "fare_amt", [(4, 0.2)], 8, "ours")[0]
    other = GBTRegressor(labelCol="fare_amt", predictionCol="theirs", maxIter=8, maxDepth=4, stepSize=0.2).fit(rows)
    both = model.transform(other.transform(rows))
    assert both.agg(F.max(F.abs(F.col("ours") - F.col("theirs")))).first()[0] < 1e-9


def test_columns_summed_by_joint_bins_give_the_sums_of_each_feature():
    draw, rows, widths = np.random.default_rng(3), 500, [32, 30, 5, 24, 7, 2]
    binning = Bins.of({k: np.arange(w - 1) + 0.5 for k, w in enumerate(widths) if w > 2}, len(widths))
    columns = np.stack([draw.integers(0, w, rows) for w in widths]).astype(np.uint8)
    none, labels = np.empty(0, np.int32), draw.normal(size=rows)
    block = boosting.Block(0, np.arange(len(widths)), columns, none, none, labels, [np.zeros(rows)])
    joint = block.joint_columns(binning)
    assert len(joint) < len(widths)
    assert all(np.prod(of) <= boosting.JOINT_BINS for _, of, _ in joint)
    tree = boosting.Tree.empty(2)
    tree.feature[0], tree.split[0], tree.value[1:3] = 0, 15, np.nan
    found = {}
    for _, ((keys, counts, sums), totals) in boosting.level_sums(block, joint, labels * 0, tree, binning, 1, True):
        found |= {int(k): (int(n), total) for k, n, total in zip(keys, counts, sums, strict=True)}
    assert totals[:, 0].tolist() == [np.sum(columns[0] <= 15), np.sum(columns[0] > 15)]
    for row_node in range(2):
        of_node = (columns[0] > 15) == row_node
        for name, width in enumerate(widths):
            for at in range(width):
                here = of_node & (columns[name] == at)
                key = int(row_node * binning.starts[-1] + binning.starts[name] + at)
                assert (key in found) == here.any()
                if here.any():
                    assert found[key] == (here.sum(), pytest.approx(labels[here].sum()))


def test_tasks_of_both_languages_grow_the_same_trees(spark, monkeypatch):
    """Java tasks over several parts of a table, zones kept whole in a part, and the Python tasks."""
    tables, settings = [rows_of(spark, 300, 5), rows_of(spark, 700, 60)], [(2, 0.3), (4, 0.1)]
    monkeypatch.setattr(boosting, "LEAST_BLOCK_ROWS", 100)
    made = []
    whole = boosting.JavaRows
    monkeypatch.setattr(boosting, "JavaRows", lambda *given: made.append(whole(*given)) or made[-1])
    found = fit_tables(tables, "fare_amt", settings, 23, "p")
    assert made[0].reducers
    monkeypatch.setattr(boosting, "has_compiler", lambda session: False)
    for java, python in zip(found, fit_tables(tables, "fare_amt", settings, 23, "p"), strict=True):
        for one, other in zip(java, python, strict=True):
            for a, b in zip(one.features + one.thresholds, other.features + other.thresholds, strict=True):
                np.testing.assert_array_equal(a, b)
            np.testing.assert_allclose(np.concatenate(one.values), np.concatenate(other.values), rtol=1e-8, atol=1e-10)
