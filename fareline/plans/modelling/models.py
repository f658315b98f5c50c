"""Grid search over expanding folds, refit and hold-out scores with Spark ML."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.functions.trips import fare_band
from fareline.operators.profile import file_fingerprint, materialise, table_digest
from fareline.plans.modelling.boosting import BoostedTrees, dealt, fit_tables, task_count
from fareline.plans.modelling.features import fit_preprocessing
from fareline.plans.modelling.metrics import baseline_scores, macro_metrics, regression_metrics
from fareline.plans.modelling.softmax import fit_softmax
from fareline.plans.modelling.split import (
    Fold,
    Split,
    chronological_folds,
    fold_starts,
    ml_frame,
    split_summary,
)
from fareline.session import cached, written

# The search grids, boosting rounds, solver iterations and seed.
REGRESSION_GRID = {"max_depth": (3, 5), "learning_rate": (0.05, 0.15)}
CLASSIFICATION_GRID = {"C": (0.1, 1.0, 10.0)}
ROUNDS = 100
SOLVER_ITERATIONS = 2_000
SEED = 42
N_SPLITS = 3
#: The refit grows with the folds, for all settings, if a level of all of them takes so many waves
#: of tasks at most: a wave costs less than a refit's own jobs. Else only the best setting is refitted.
WAVES = 2
# Fixed value: how a model record describes its evaluation.
VALIDATION = "three expanding chronological folds and final 20% time holdout"

Params = dict[str, float]


def settings(grid: Mapping[str, Sequence[float]]) -> list[Params]:
    """All combinations, in the order of the parameter names: the first best one wins."""
    names = sorted(grid)
    return [
        dict(zip(names, values, strict=True))
        for values in itertools.product(*[grid[name] for name in names])
    ]


def fit_fares(
    tables: Sequence[DataFrame], params: Sequence[Params], rounds: int = ROUNDS
) -> list[list[BoostedTrees]]:
    """Boosted trees of every setting for each table, all grown in the same jobs."""
    pairs = [(int(one["max_depth"]), float(one["learning_rate"])) for one in params]
    return fit_tables(tables, "fare_amt", pairs, rounds, "predicted_fare")


def fit_fare(train: DataFrame, rows: int, params: Params, rounds: int = ROUNDS) -> BoostedTrees:
    return fit_fares([train], [params], rounds)[0][0]


def band_estimator(inverse_penalty: float, rows: int) -> LogisticRegression:
    """Multinomial logistic regression; Spark averages the loss, so C is scaled by the rows."""
    return LogisticRegression(
        labelCol="band",
        predictionCol="predicted_band",
        family="multinomial",
        elasticNetParam=0.0,
        regParam=1.0 / (inverse_penalty * rows),
        standardization=False,
        maxIter=SOLVER_ITERATIONS,
    )


def fit_bands(tables: Sequence[DataFrame], params: Sequence[Params]) -> list[list[Model]]:
    """Logistic regressions of every setting for each table, all fitted in the same jobs."""
    return fit_softmax(tables, band_estimator, [float(one["C"]) for one in params])


def fit_band(train: DataFrame, rows: int, params: Params) -> Model:
    return fit_bands([train], [params])[0][0]


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("band", fare_band(F.col("fare_amt")).cast("double"))


KEPT = ("row_id", "fare_amt", "band")


def in_threads(spark: SparkSession, run: Callable, jobs: Sequence, parallelism: int) -> list:
    """Submit Spark jobs from a few driver threads; the executors do the work."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(run), jobs, chunksize=1)


@dataclass(frozen=True)
class Task:
    """What is tuned: how to fit, and whether a smaller score is better. Errors (RMSE) are scores of
    numbers, macro F1 is the score of bands."""

    name: str
    grid: Mapping[str, Sequence[float]]
    fit: Callable[[DataFrame, int, Params], Model | BoostedTrees]
    smaller_is_better: bool
    #: Fits several settings on several tables in the same jobs, where that is possible.
    fit_together: Callable[[Sequence[DataFrame], Sequence[Params]], list[list]] | None = None


def fare_task(
    grid: Mapping[str, Sequence[float]] = REGRESSION_GRID, rounds: int = ROUNDS
) -> Task:
    def fit(train: DataFrame, rows: int, params: Params) -> BoostedTrees:
        return fit_fare(train, rows, params, rounds)

    def fit_together(tables: Sequence[DataFrame], params: Sequence[Params]) -> list[list[BoostedTrees]]:
        return fit_fares(tables, params, rounds)

    return Task("regression", grid, fit, True, fit_together)


def band_task(grid: Mapping[str, Sequence[float]] = CLASSIFICATION_GRID) -> Task:
    return Task("classification", grid, fit_band, False, fit_bands)


def with_prediction(model: Model, column: str) -> Model:
    """A copy of a fitted model that adds its prediction alone, under the given name."""
    alone = model.copy().setPredictionCol(column)
    for other in ("setRawPredictionCol", "setProbabilityCol"):
        if hasattr(alone, other):
            getattr(alone, other)("")
    return alone


def stacked_scores(rows: DataFrame, tasks: Sequence[Task], models: Sequence[Model]) -> list[float]:
    """Score of every model, from one pass over the rows that predicts with all of them.

    The predictions are stacked and counted: a number of a model is one row with the sum of its
    squared errors, bands are one row for each pair of truth and prediction. So what comes back is a
    few rows for each model, whatever the number of rows.
    """
    frame = rows
    for number, model in enumerate(models):
        frame = with_prediction(model, f"_predicted{number}").transform(frame)
    no_band = F.lit(None).cast("double")

    def entry(number: int, task: Task) -> Column:
        predicted = F.col(f"_predicted{number}")
        error = predicted - F.col("fare_amt")
        number_of = F.lit(number).alias("model")
        if task.smaller_is_better:
            return F.struct(number_of, no_band.alias("truth"), no_band.alias("said"), (error * error).alias("square"))
        return F.struct(number_of, F.col("band").alias("truth"), predicted.alias("said"), no_band.alias("square"))

    stacked = frame.select(F.inline(F.array(*[entry(n, task) for n, task in enumerate(tasks)])))
    counted = stacked.groupBy("model", "truth", "said").agg(
        F.count("*").alias("n"), F.sum("square").alias("squares")
    )
    found: dict[int, list] = {}
    for row in counted.collect():
        found.setdefault(row["model"], []).append(row)
    return [
        math.sqrt(found[n][0]["squares"] / found[n][0]["n"]) if task.smaller_is_better else macro_f1(found[n])
        for n, task in enumerate(tasks)
    ]


def macro_f1(counts: Sequence) -> float:
    """Unweighted mean of F1 over the labels in truth or prediction, from their pair counts."""
    labels = {row["truth"] for row in counts} | {row["said"] for row in counts}
    scores = []
    for label in labels:
        hits = sum(row["n"] for row in counts if row["truth"] == row["said"] == label)
        named = sum(row["n"] for row in counts for side in ("truth", "said") if row[side] == label)
        scores.append(2 * hits / named)
    return sum(scores) / len(scores)


def fold_scores(split: Split, tasks: Sequence[Task], parallelism: int = 2) -> list[tuple]:
    """Score of every setting on every fold: (task, setting, params, fold, score)."""
    return search(split, tasks, parallelism)[0]


def search(
    split: Split, tasks: Sequence[Task], parallelism: int = 2, whole: DataFrame | None = None
) -> tuple[list[tuple], dict[str, list]]:
    """The scores of :func:`fold_scores` and, for each task whose settings are fitted together, the
    models of all its settings on the rows of ``whole``.

    Folds and fits are Spark jobs submitted from a few driver threads; settings that can be fitted in
    the same jobs are, on all folds and on ``whole``. One job scores all settings of a fold.
    """
    spark = split.train.sparkSession
    folds = list(chronological_folds(split.train, N_SPLITS))

    with ExitStack() as held:

        def prepare(fold: Fold) -> tuple:
            train = labelled(split.train.where(fold.train))
            rows = train.count()
            prepared = fit_preprocessing(train, split.features)
            return prepared, rows, held.enter_context(cached(dealt(prepared.transform(train, KEPT), rows)))

        ready = in_threads(spark, prepare, folds, min(parallelism, N_SPLITS))
        tables = [fit_rows for _, _, fit_rows in ready]

        def fit(group: tuple) -> list[list]:
            task, place, params = group
            if task.fit_together:
                return task.fit_together(tables + ([] if whole is None else [whole]), params)
            return [[task.fit(tables[place], ready[place][1], one) for one in params]]

        # A group is fitted by one thread: all folds and settings together, or one setting of a fold.
        groups = []
        for task in tasks:
            every = settings(task.grid)
            single = [(task, place, [params]) for place in range(len(folds)) for params in every]
            groups += [(task, None, every)] if task.fit_together else single
        fitted = in_threads(spark, fit, groups, parallelism)

    by_fold: list[list] = [[] for _ in folds]
    on_whole = {}
    for (task, place, _), found in zip(groups, fitted, strict=True):
        for number, models in enumerate(found):
            if task.fit_together and number == len(folds):
                on_whole[task.name] = models
            else:
                by_fold[number if place is None else place] += models
    jobs = [
        (task, number, params)
        for task in tasks
        for number, params in enumerate(settings(task.grid))
    ]

    def score(place: int) -> list[tuple]:
        fold, prepared = folds[place], ready[place][0]
        test = labelled(split.train.where(fold.test))
        values = stacked_scores(prepared.transform(test, KEPT), [job[0] for job in jobs], by_fold[place])
        return [
            (task.name, number, params, fold.number, value)
            for (task, number, params), value in zip(jobs, values, strict=True)
        ]

    found = in_threads(spark, score, range(len(folds)), min(parallelism, N_SPLITS))
    return [score for scores in found for score in scores], on_whole


def cores_left(rows: DataFrame, count: int) -> bool:
    """Whether the folds of ``count`` rows and all the rows themselves have no more tasks than cores."""
    parts = [*fold_starts(count, N_SPLITS), count]
    tasks = sum(task_count(rows, part) for part in parts)
    return tasks <= rows.sparkSession.sparkContext.defaultParallelism * WAVES


def cv_table(spark: SparkSession, scores: Sequence[tuple], task: Task) -> DataFrame:
    """Per setting: a column ``param_<name>`` for each parameter, fold scores, their mean and
    deviation, and the rank (1 is best)."""
    names = sorted(task.grid)
    rows = [
        (name, number, *[float(params[key]) for key in names], fold, score)
        for name, number, params, fold, score in scores
        if name == task.name
    ]
    parameters = "".join(f"param_{key} double, " for key in names)
    schema = f"task string, setting int, {parameters}fold int, score double"
    frame = spark.createDataFrame(rows, schema)
    by_fold = [
        F.max(F.when(F.col("fold") == number, F.col("score"))).alias(f"split{number}_test_score")
        for number in range(N_SPLITS)
    ]
    table = frame.groupBy("task", "setting").agg(
        *[F.first(f"param_{key}").alias(f"param_{key}") for key in names],
        *by_fold,
        F.avg("score").alias("mean_test_score"),
        F.stddev_pop("score").alias("std_test_score"),
    )
    order = F.asc("mean_test_score") if task.smaller_is_better else F.desc("mean_test_score")
    # One row per setting of the grid.
    return table.withColumn("rank_test_score", F.rank().over(Window.orderBy(order)))


def best_setting(scores: Sequence[tuple], task: Task) -> tuple[Params, float]:
    """Setting with the best mean over the folds; the first one on ties."""
    sign = 1.0 if task.smaller_is_better else -1.0
    means = []
    for number, params in enumerate(settings(task.grid)):
        values = [s for name, n, _, _, s in scores if name == task.name and n == number]
        means.append((params, sum(values) / len(values)))
    return min(means, key=lambda pair: sign * pair[1])


def holdout_predictions(split: Split, task: Task, params: Params, predicted: str) -> DataFrame:
    """Fit one setting on the training side and predict the hold-out."""
    train, test = labelled(split.train), labelled(split.test)
    prepared = fit_preprocessing(train, split.features)
    with cached(dealt(prepared.transform(train, KEPT), split.train_rows)) as fit_rows:
        model = task.fit(fit_rows, split.train_rows, params)
    outcome = model.transform(prepared.transform(test, KEPT))
    return written(outcome.select(*KEPT, predicted), "predictions")


@dataclass(frozen=True)
class FareModels:
    """Search results, the refitted models, and their predictions on the hold-out."""

    cv_regression: DataFrame
    cv_classification: DataFrame
    regressor: BoostedTrees
    classifier: Model
    best_fare: tuple[Params, float]
    best_band: tuple[Params, float]
    predictions: DataFrame
    #: Seconds of reading the rows, of fitting the preprocessing, and of the search with its refit.
    timings: dict[str, float]


def fit_fare_models(
    split: Split,
    rounds: int = ROUNDS,
    regression_grid: Mapping[str, Sequence[float]] = REGRESSION_GRID,
    classification_grid: Mapping[str, Sequence[float]] = CLASSIFICATION_GRID,
    parallelism: int = 2,
) -> FareModels:
    """Tune on the folds of the training side, refit on all of it, predict the hold-out."""
    spark = split.train.sparkSession
    fare, band = fare_task(regression_grid, rounds), band_task(classification_grid)
    started = time.perf_counter()
    materialise(split.train.unionByName(split.test))
    read = time.perf_counter()
    train, test = labelled(split.train), labelled(split.test)
    prepared = fit_preprocessing(train, split.features)
    fitted = time.perf_counter()
    with cached(dealt(prepared.transform(train, KEPT), split.train_rows)) as fit_rows:
        early = fit_rows if cores_left(train, split.train_rows) else None
        scores, on_whole = search(split, [fare, band], parallelism, early)
        best_fare, best_band = best_setting(scores, fare), best_setting(scores, band)

        def refit(pair: tuple) -> Model | BoostedTrees:
            task, params = pair
            if task.name in on_whole:
                return on_whole[task.name][settings(task.grid).index(params)]
            return task.fit(fit_rows, split.train_rows, params)

        chosen = [(fare, best_fare[0]), (band, best_band[0])]
        regressor, classifier = in_threads(spark, refit, chosen, parallelism)
    timings = {
        "read_seconds": read - started,
        "preprocessing_seconds": fitted - read,
        "tuning_seconds": time.perf_counter() - fitted,
    }
    predictions = classifier.transform(regressor.transform(prepared.transform(test, KEPT)))
    return FareModels(
        cv_table(spark, scores, fare),
        cv_table(spark, scores, band),
        regressor,
        classifier,
        best_fare,
        best_band,
        written(predictions.select(*KEPT, "predicted_fare", "predicted_band"), "predictions"),
        timings,
    )


def model_record(
    df: DataFrame,
    models: FareModels,
    split: Split,
    dataset: str,
    paths: Sequence[str] = (),
) -> DataFrame:
    """One row that documents a model run, in the layout the results reader expects."""
    spark = df.sparkSession
    if paths:
        digest = table_digest(file_fingerprint(spark, *paths)).first()["sha256"]
    else:
        digest = None
    outcome = models.predictions
    # Each of these is one row of numbers.
    fare = regression_metrics(outcome, "fare_amt", "predicted_fare").first()
    band = macro_metrics(outcome, "band", "predicted_band").first()
    base = baseline_scores(split).first()
    params = {
        name: F.create_map(*[F.lit(x) for pair in best.items() for x in (pair[0], float(pair[1]))])
        for name, best in (("fare", models.best_fare[0]), ("band", models.best_band[0]))
    }
    regression = F.struct(
        *[F.lit(fare[name]).cast("double").alias(name) for name in ("rmse", "mae", "r2")],
        F.lit(base["baseline_mae"]).alias("baseline_mae"),
        params["fare"].alias("best_params"),
        F.lit(models.best_fare[1]).alias("cv_rmse"),
    )
    macro = ("accuracy", "macro_precision", "macro_recall", "macro_f1")
    classification = F.struct(
        *[F.lit(band[name]).cast("double").alias(name) for name in macro],
        F.lit(base["baseline_accuracy"]).alias("baseline_accuracy"),
        params["band"].alias("best_params"),
    )
    return split_summary(df, split).select(
        F.lit(dataset).alias("dataset"),
        F.lit(digest).cast("string").alias("sha256"),
        F.lit(split.stage).alias("stage"),
        "raw_rows",
        "train_rows",
        "test_rows",
        F.array(*[F.lit(name) for name in split.features]).alias("features"),
        F.col("train_end").cast("string").alias("train_end"),
        F.col("test_start").cast("string").alias("test_start"),
        F.create_map(*[F.lit(x) for pair in models.timings.items() for x in pair]).alias("timings"),
        regression.alias("regression"),
        classification.alias("classification"),
        F.lit(VALIDATION).alias("validation"),
    )


def stage_comparison(
    df: DataFrame,
    stages: Sequence[str],
    max_rows: int | None = None,
    fit: Callable[..., FareModels] = fit_fare_models,
    **search,
) -> DataFrame:
    """The same evaluation per stage, one row each: the stages answer different questions.

    ``search`` goes to ``fit``, which may also hand back models of an earlier search.
    """

    def record(stage: str) -> DataFrame:
        split = ml_frame(df, max_rows, stage)
        return model_record(df, fit(split, **search), split, stage)

    return reduce(DataFrame.unionByName, in_threads(df.sparkSession, record, stages, len(stages)))
