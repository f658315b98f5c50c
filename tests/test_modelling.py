import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareline.operators.reporting import model_scores
from fareline.plans.modelling.features import (
    encoded_zones,
    fit_preprocessing,
    fit_scaling,
    fit_zone,
)
from fareline.plans.modelling.metrics import (
    baseline_scores,
    confusion_matrix,
    macro_metrics,
    regression_metrics,
)
from fareline.plans.modelling.models import (
    CLASSIFICATION_GRID,
    KEPT,
    REGRESSION_GRID,
    band_task,
    best_setting,
    cv_table,
    fare_task,
    fit_band,
    fit_fare_models,
    labelled,
    model_record,
    settings,
    stacked_scores,
    stage_comparison,
)
from fareline.plans.modelling.split import (
    LEAKAGE,
    MOMENT,
    chronological_split,
    clean_fares,
    expanding_folds,
    fold_starts,
    ml_frame,
    split_summary,
    stage_features,
)
from fareline.sources.records import load_results, write_records
from fareline.sources.synthetic import synthetic_trips

START = datetime(2015, 1, 1)


def timed(spark, days, fares=None):
    rows = [
        (i, START + timedelta(days=day), float(fares[i]) if fares else 5.0 + i % 30)
        for i, day in enumerate(days)
    ]
    random.Random(4).shuffle(rows)
    schema = "row_id bigint, pickup_datetime timestamp_ntz, fare_amt double"
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(row.row_id for row in df.select("row_id").collect())


@pytest.fixture(scope="module")
def trips(spark):
    return synthetic_trips(spark, 1_000).cache()


def test_split_puts_ties_on_the_test_side(spark):
    split = chronological_split(timed(spark, [0, 1, 2, 3, 4, 5, 6, 8, 8, 9]))
    assert ids(split.train) == [0, 1, 2, 3, 4, 5, 6]
    assert ids(split.test) == [7, 8, 9]
    assert (split.train_rows, split.test_rows) == (7, 3)


def test_split_position_is_truncated(spark):
    split = chronological_split(timed(spark, range(9)))
    assert ids(split.test) == [7, 8]


def test_split_of_nothing(spark):
    with pytest.raises(ValueError, match="no rows"):
        chronological_split(timed(spark, [0]).where("row_id > 5"))


def test_ml_frame_is_chronological_and_free_of_leakage(trips):
    split = ml_frame(trips)
    assert split.train.agg(F.max(MOMENT)).first()[0] < split.test.agg(F.min(MOMENT)).first()[0]
    assert not set(split.features) & set(LEAKAGE)
    assert split.train_rows == split.train.count() and split.test_rows == split.test.count()
    completed = stage_features(trips.columns, "completed-trip")
    assert {"trip_distance", "end_lon", "end_lat"} <= set(completed)
    assert not {"fare_amt", "tip_amt"} & set(completed)
    with pytest.raises(ValueError, match="stage"):
        stage_features(trips.columns, "later")


def test_ml_frame_respects_the_budget_and_the_least_sizes(spark, trips):
    split = ml_frame(trips, max_rows=600)
    assert split.train_rows + split.test_rows == 600
    assert ids(split.train.union(split.test)) == ids(
        ml_frame(trips.repartition(5), max_rows=600).train.union(split.test)
    )
    with pytest.raises(ValueError, match="not enough"):
        ml_frame(synthetic_trips(spark, 200))


def test_cleaning_bounds_are_inclusive(spark):
    df = timed(spark, [0] * 6, [0.0, 0.01, 500, 500.01, -1, 7])
    assert ids(clean_fares(df)) == [1, 2, 5]
    schema = "pickup_datetime string, fare_amt double"
    text = spark.createDataFrame([("2015-01-01", 5.0), ("x", 5.0)], schema)
    assert clean_fares(text).count() == 1


def brute_force_folds(rows, n_splits=3):
    """Expanding folds by positions of a sorted list of (time, id)."""
    ordered = sorted(rows)
    part = len(ordered) // (n_splits + 1)
    members = set()
    for fold in range(n_splits):
        start = len(ordered) - (n_splits - fold) * part
        cutoff = ordered[start][0]
        members |= {(fold, "train", key) for time, key in ordered[:start] if time < cutoff}
        members |= {(fold, "test", key) for _, key in ordered[start : start + part]}
    return members


@pytest.mark.parametrize(
    "days",
    [list(range(13)), [0, 0, 1, 2, 2, 2, 2, 3, 4, 4, 5, 5], [7] * 9, [i // 40 for i in range(200)]],
)
def test_folds_match_brute_force(spark, days):
    df = timed(spark, days)
    found = {(row.fold, row.role, row.row_id) for row in expanding_folds(df).collect()}
    rows = [(row.pickup_datetime, row.row_id) for row in df.collect()]
    assert found == brute_force_folds(rows)


def test_rows_tied_with_the_cut_join_neither_side(spark):
    df = timed(spark, [0, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 9])
    first = expanding_folds(df).where("fold = 0")
    assert ids(first.where("role = 'train'")) == [0, 1]
    assert ids(first.where("role = 'test'")) == [3, 4, 5]


def test_too_few_rows_for_folds():
    assert fold_starts(12) == [3, 6, 9]
    with pytest.raises(ValueError):
        fold_starts(3)


def test_scaling(spark):
    schema = "row_id bigint, a double, b double, c double"
    rows = [(0, 1.0, None, 3.0), (1, 2.0, None, 3.0), (2, 4.0, None, 3.0), (3, 10.0, None, None)]
    df = spark.createDataFrame([*rows, (4, None, None, 3.0)], schema)
    fitted = fit_scaling(df, ["a", "b", "c"])
    filled = np.array([1, 2, 4, 10, 3.0])
    assert fitted["a"].median == 3.0
    assert fitted["a"].mean == pytest.approx(filled.mean())
    assert fitted["a"].spread == pytest.approx(filled.std())
    assert (fitted["b"].median, fitted["b"].mean, fitted["b"].spread) == (0.0, 0.0, 1.0)
    assert (fitted["c"].mean, fitted["c"].spread) == (3.0, 1.0)


def zones(spark, values, name="pickup_zone"):
    rows = [(i, value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, f"row_id bigint, {name} double")


def test_zone_mode_takes_the_smallest_on_ties(spark):
    assert fit_zone(zones(spark, [2.0, 1.0, 2.0, 1.0, None]), "pickup_zone").mode == 1.0
    assert fit_zone(zones(spark, [None, None]), "pickup_zone") is None


def test_rare_zones_share_a_label_and_unseen_ones_have_none(spark):
    train = zones(spark, [7.0] * 5 + [8.0] * 4 + [9.0])
    test = zones(spark, [7.0, 8.0, 9.0, 10.0, None])
    found = encoded_zones(test, [fit_zone(train, "pickup_zone")]).orderBy("row_id").collect()
    assert [row.label for row in found] == ["7.0", "infrequent", "infrequent", None, "7.0"]


def test_imputed_rows_count_for_the_mode(spark):
    train = zones(spark, [3.0, 3.0, 3.0, None, None, 4.0])
    coding = fit_zone(train, "pickup_zone")
    labels = {row.category: (row.n, row.label) for row in coding.categories.collect()}
    assert labels == {3.0: (5, "3.0"), 4.0: (1, "infrequent")}


def test_feature_vectors(spark):
    rows = [(i, float(i), 7.0 if i < 6 else 8.0, 1.0 + i % 2) for i in range(10)]
    schema = "row_id bigint, passenger_count double, pickup_zone double, dropoff_zone double"
    train = spark.createDataFrame(rows, schema)
    features = ["passenger_count", "pickup_zone", "dropoff_zone"]
    fitted = fit_preprocessing(train, features)
    test = spark.createDataFrame(
        [(0, None, 7.0, 1.0), (1, 9.0, 8.0, 2.0), (2, 9.0, 99.0, 99.0)], schema
    )
    rows = fitted.transform(test, ["row_id"]).collect()
    found = {row.row_id: row.features.toArray().tolist() for row in rows}
    # One scaled number, slots '7.0' and 'infrequent', slots '1.0' and '2.0'.
    assert found[0][1:] == [1, 0, 1, 0] and found[0][0] == pytest.approx(0.0)
    assert found[1][1:] == [0, 1, 0, 1]
    assert found[2][1:] == [0, 0, 0, 0]


def test_fitting_ignores_the_validation_side(spark):
    train = zones(spark, [1.0] * 6).withColumn("trip_distance", F.lit(2.0))
    fitted = fit_preprocessing(train, ["trip_distance", "pickup_zone"])
    other = zones(spark, [1.0, 500.0]).withColumn("trip_distance", F.lit(1e9))
    rows = fitted.transform(other, ["row_id"]).orderBy("row_id").collect()
    assert rows[0].features.size == 2
    assert rows[1].features.toArray().tolist() == [1e9 - 2.0, 0.0]


def test_vectors_do_not_name_their_slots(spark):
    train = zones(spark, [float(zone) for zone in range(40) for _ in range(5)])
    fitted = fit_preprocessing(train, ["pickup_zone"])
    assert fitted.transform(train, ["row_id"]).schema["features"].metadata == {}


def test_regression_metrics(spark):
    rows = [(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (7.0, 9.0)]
    truth, guess = np.array(rows).T
    row = regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert row.rmse == pytest.approx(np.sqrt(np.mean((truth - guess) ** 2)))
    assert row.mae == pytest.approx(1.0)
    assert row.r2 == pytest.approx(1 - 6 / np.sum((truth - truth.mean()) ** 2))


def brute_force_macro(pairs):
    labels = sorted({x for pair in pairs for x in pair})
    scores = []
    for label in labels:
        hit = sum(1 for y, p in pairs if y == p == label)
        claimed = sum(1 for _, p in pairs if p == label)
        actual = sum(1 for y, _ in pairs if y == label)
        precision = hit / claimed if claimed else 0.0
        recall = hit / actual if actual else 0.0
        total = precision + recall
        scores.append((precision, recall, 2 * precision * recall / total if total else 0.0))
    return np.mean(scores, axis=0)


@pytest.mark.parametrize(
    "pairs",
    [
        [(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)],
        [(0, 1), (1, 1), (2, 1), (1, 1)],
        [(1, 1), (1, 1)],
        [(0, 2), (0, 2), (1, 1)],
    ],
)
def test_macro_metrics_match_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "y int, p int")
    row = macro_metrics(df, "y", "p").first()
    expected = brute_force_macro(pairs)
    assert row.accuracy == pytest.approx(sum(y == p for y, p in pairs) / len(pairs))
    np.testing.assert_allclose([row.macro_precision, row.macro_recall, row.macro_f1], expected)
    counts = {(r.truth, r.predicted): r.n for r in confusion_matrix(df, "y", "p").collect()}
    assert sum(counts.values()) == len(pairs)


def test_baselines(spark):
    fares = [5, 6, 12, 13, 30, 31, 7, 8, 12, 40]
    row = baseline_scores(chronological_split(timed(spark, range(10), fares))).first()
    assert row.train_median == 10.0
    # Bands 0 and 1 ... band 0 holds 5, 6, 7, 8.
    assert (row.train_majority, row.baseline_mae, row.baseline_accuracy) == (0, 16.0, 0.0)


def test_split_summary(spark):
    df = timed(spark, range(10))
    row = split_summary(df, chronological_split(df)).first()
    assert (row.raw_rows, row.train_rows, row.test_rows) == (10, 8, 2)
    assert (row.train_end, row.test_start) == (START + timedelta(days=7), START + timedelta(days=8))


def test_grid_order_and_first_best(spark):
    order = settings(REGRESSION_GRID)
    assert [(p["learning_rate"], p["max_depth"]) for p in order] == [
        (0.05, 3),
        (0.05, 5),
        (0.15, 3),
        (0.15, 5),
    ]
    assert [p["C"] for p in settings(CLASSIFICATION_GRID)] == [0.1, 1.0, 10.0]
    task = fare_task({"max_depth": (1, 2)})
    scores = [
        ("regression", n, p, fold, score)
        for n, p in enumerate(settings(task.grid))
        for fold, score in enumerate([3.0, 2.0, 1.0])
    ]
    assert best_setting(scores, task) == ({"max_depth": 1}, 2.0)
    rows = cv_table(spark, scores, task).orderBy("setting").collect()
    assert [row.rank_test_score for row in rows] == [1, 1]
    assert rows[0].split0_test_score == 3.0
    assert rows[0].std_test_score == pytest.approx(np.std([3, 2, 1]))


@pytest.mark.parametrize("bands", [(0.0, 2.0), (1.0, 1.0)])
def test_absent_bands_do_not_break_the_fit(spark, bands):
    from pyspark.ml.linalg import Vectors

    rows = [(bands[i % 2], Vectors.dense([float(i % 2), i / 40])) for i in range(40)]
    df = spark.createDataFrame(rows, ["band", "features"])
    found = {r.predicted_band for r in fit_band(df, 40, {"C": 1.0}).transform(df).collect()}
    assert found == set(bands)


def test_stacked_scores_equal_single_ones(spark, trips):
    """One job scores regression and classification models; each score is that of the model alone."""
    split = ml_frame(trips, stage="completed-trip")
    train, test = labelled(split.train), labelled(split.test)
    prepared = fit_preprocessing(train, split.features)
    fit_rows, score_rows = prepared.transform(train, KEPT).cache(), prepared.transform(test, KEPT).cache()
    fare, band = fare_task(rounds=3), band_task()
    models = [
        fare.fit(fit_rows, 800, {"max_depth": 2, "learning_rate": 0.1}),
        band.fit(fit_rows, 800, {"C": 1.0}),
        fare.fit(fit_rows, 800, {"max_depth": 3, "learning_rate": 0.3}),
    ]
    scores = stacked_scores(score_rows, [fare, band, fare], models)
    for k in (0, 2):
        alone = regression_metrics(models[k].transform(score_rows), "fare_amt", "predicted_fare")
        assert scores[k] == pytest.approx(alone.first()["rmse"])
    alone = macro_metrics(models[1].transform(score_rows), "band", "predicted_band")
    assert scores[1] == pytest.approx(alone.first()["macro_f1"])


def test_models_end_to_end(spark, trips, tmp_path):
    options = {
        "rounds": 8,
        "regression_grid": {"max_depth": (3,), "learning_rate": (0.15,)},
        "classification_grid": {"C": (1.0, 10.0)},
    }
    split = ml_frame(trips, stage="completed-trip")
    models = fit_fare_models(split, **options)
    assert models.predictions.count() == split.test_rows
    assert models.cv_classification.count() == 2
    record = model_record(trips, models, split, "synthetic")
    row = record.first()
    assert 0 < row.regression.mae < row.regression.baseline_mae
    assert row.classification.accuracy > row.classification.baseline_accuracy
    assert 0 <= row.classification.macro_f1 <= 1
    assert (row.raw_rows, row.train_rows, row.test_rows) == (1000, 800, 200)
    assert row.train_end < row.test_start
    path = str(tmp_path / "models")
    write_records(record, path)
    scores = model_scores(load_results(spark, path, multi_line=False).models).first()
    assert (scores.stage, scores.rmse) == ("completed-trip", row.regression.rmse)


def test_completed_trips_are_easier(trips):
    compared = stage_comparison(
        trips,
        ("pickup", "completed-trip"),
        rounds=5,
        regression_grid={"max_depth": (3,), "learning_rate": (0.15,)},
        classification_grid={"C": (1.0,)},
    )
    rmse = {row.stage: row.regression.rmse for row in compared.collect()}
    assert rmse["completed-trip"] < rmse["pickup"]
