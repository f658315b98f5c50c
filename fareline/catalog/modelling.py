"""Model-preparation, metric and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.catalog.registry import Query, rounded
from fareline.catalog.sampling import BOUNDARY_SQL
from fareline.catalog.views import (
    SPARSE_SQL,
    TIMED_SQL,
    TRIPS_SQL,
    table,
    trips,
    trips_sparse,
    trips_timed,
)
from fareline.functions.trips import fare_band
from fareline.operators.reporting import model_scores
from fareline.plans.modelling.features import encoded_zones, fit_preprocessing, fit_zone
from fareline.plans.modelling.metrics import (
    baseline_scores,
    confusion_matrix,
    macro_metrics,
    regression_metrics,
)
from fareline.plans.modelling.models import (
    FareModels,
    Task,
    band_task,
    cv_table,
    fare_task,
    fit_fare,
    fit_fare_models,
    holdout_predictions,
    model_record,
    stage_comparison,
)
from fareline.plans.modelling.split import (
    COMPLETED_FEATURES,
    MOMENT,
    STAGES,
    Split,
    chronological_split,
    ml_frame,
    split_summary,
)
from fareline.session import new_path, written
from fareline.sources.records import load_results, write_csv, write_records

# Driver threads that submit the fits of a search.
THREADS = 8
NUMBERS = ("passenger_count", "trip_distance", "start_lon", "end_lon")
MODEL_COLUMNS = (
    "fare_amt",
    "passenger_count",
    "start_lon",
    "start_lat",
    "pickup_zone",
    *COMPLETED_FEATURES,
)


def frame(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of the hold-out with the features of the completed trip."""
    split = ml_frame(trips(spark, folder), stage="completed-trip")
    sides = [(split.train, "train"), (split.test, "test")]
    parts = [df.select(F.lit(role).alias("role"), "*") for df, role in sides]
    both = parts[0].unionByName(parts[1])
    return rounded(both, ("start_lon", "start_lat", "end_lon", "end_lat"), 9)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    timed = trips_timed(spark, folder)
    return split_summary(timed, chronological_split(timed))


def prepared(trips: DataFrame, *columns: str) -> DataFrame:
    """Trips written once: fitting reads them many times, and the view parses JSON."""
    return written(trips.select("row_id", MOMENT, *columns), "trips")


def scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric features of all sparse trips, scaled by statistics of the training side."""
    sparse = prepared(trips_sparse(spark, folder), *NUMBERS)
    split = chronological_split(sparse)
    fitted = fit_preprocessing(split.train, NUMBERS)
    return rounded(fitted.scaled(sparse), NUMBERS)


def scaled_by_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with the medians found by counting passes."""
    sparse = prepared(trips_sparse(spark, folder), *NUMBERS)
    split = chronological_split(sparse)
    fitted = fit_preprocessing(split.train, NUMBERS)
    return rounded(fitted.scaled(sparse), NUMBERS)


def zoned(spark: SparkSession, folder: str) -> DataFrame:
    """Customer zones of all orders, encoded by the categories of the training side."""
    zone = F.when(F.col("passenger_count") < 6, F.col("pickup_zone"))
    timed = trips_timed(spark, folder).withColumn("pickup_zone", zone)
    split = chronological_split(timed)
    return encoded_zones(timed, [fit_zone(split.train, "pickup_zone")])


def zone_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The slot of each order's zone in the one-hot vector, NULL where the vector is all zeros."""
    zone = F.when(F.col("passenger_count") < 6, F.col("pickup_zone"))
    timed = trips_timed(spark, folder).withColumn("pickup_zone", zone)
    coding = fit_zone(chronological_split(timed).train, "pickup_zone")
    coded = coding.slot(timed.select("row_id", "pickup_zone"), "slot")
    known = F.when(F.col("slot") < coding.width, F.col("slot").cast("int"))
    return coded.select("row_id", known.alias("slot"), F.lit(coding.width).alias("width"))


def group_means(spark: SparkSession, folder: str) -> DataFrame:
    """Trips with a predicted fare: the mean of their zone and event type."""
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("fare_amt"),
        "user_id",
        "event_type",
    )
    keys = ["user_id", "event_type"]
    means = events.groupBy(*keys).agg(F.round(F.avg("fare_amt"), 9).alias("predicted_fare"))
    joined = events.join(means, keys)
    return joined.select(
        "row_id",
        "fare_amt",
        "predicted_fare",
        fare_band(F.col("fare_amt")).alias("band"),
        fare_band(F.col("predicted_fare")).alias("predicted_band"),
    )


def fare_metrics(spark: SparkSession, folder: str) -> DataFrame:
    result = regression_metrics(group_means(spark, folder), "fare_amt", "predicted_fare")
    return rounded(result, ("rmse", "mae", "r2"))


def band_metrics(spark: SparkSession, folder: str) -> DataFrame:
    result = macro_metrics(group_means(spark, folder), "band", "predicted_band")
    return rounded(result, ("accuracy", "macro_precision", "macro_recall", "macro_f1"))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return confusion_matrix(group_means(spark, folder), "band", "predicted_band")


def baselines(spark: SparkSession, folder: str) -> DataFrame:
    split = chronological_split(trips_timed(spark, folder))
    names = ("train_median", "baseline_mae", "baseline_accuracy")
    return rounded(baseline_scores(split), names)


def scores_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Score table from model documents written as JSON and read back."""
    outcome = group_means(spark, folder)
    fare = regression_metrics(outcome, "fare_amt", "predicted_fare")
    band = macro_metrics(outcome, "band", "predicted_band")
    # One row on each side.
    both = fare.withColumn("stage", F.lit("pickup")).join(
        band.withColumn("stage", F.lit("pickup")), "stage"
    )
    document = both.select(
        F.lit("events").alias("dataset"),
        "stage",
        F.struct("rmse", "mae", "r2").alias("regression"),
        F.struct("accuracy", "macro_precision", "macro_recall", "macro_f1").alias("classification"),
    )
    path = new_path(spark, "models")
    write_records(document, path)
    scores = model_scores(load_results(spark, path, multi_line=False).models)
    return rounded(scores.drop("file"), ("rmse", "mae", "macro_f1"))


def stage_split(spark: SparkSession, folder: str, stage: str = "completed-trip"):
    return ml_frame(prepared(trips(spark, folder), *MODEL_COLUMNS), stage=stage)


def regression(spark: SparkSession, folder: str) -> DataFrame:
    """Fares of the hold-out as predicted by boosted trees."""
    params = {"max_depth": 3, "learning_rate": 0.15}
    split = stage_split(spark, folder)
    found = holdout_predictions(split, fare_task(), params, "predicted_fare")
    return found.select("row_id", "fare_amt", "predicted_fare")


def classification(spark: SparkSession, folder: str) -> DataFrame:
    """Fare bands of the hold-out as predicted by logistic regression."""
    split = stage_split(spark, folder)
    found = holdout_predictions(split, band_task(), {"C": 1.0}, "predicted_band")
    return found.select("row_id", "band", "predicted_band")


# Searches of this session: several queries show parts of the same one.
_searches: dict[tuple[str, str, str], FareModels] = {}


def searched(spark: SparkSession, folder: str, split: Split) -> FareModels:
    """Both grid searches on the folds, refits and hold-out predictions of a stage, done once."""
    key = (spark.sparkContext.applicationId, folder, split.stage)
    if key not in _searches:
        _searches[key] = fit_fare_models(split, parallelism=THREADS)
    return _searches[key]


def cv_results(spark: SparkSession, folder: str) -> DataFrame:
    """Both grid searches over the expanding folds."""
    found = searched(spark, folder, stage_split(spark, folder, "pickup"))
    return found.cv_regression.unionByName(found.cv_classification, allowMissingColumns=True)


def record_of(spark: SparkSession, folder: str) -> DataFrame:
    split = stage_split(spark, folder)
    models = searched(spark, folder, split)
    path = f"{folder}/events.parquet"
    return model_record(trips(spark, folder), models, split, "events", [path])


def record(spark: SparkSession, folder: str) -> DataFrame:
    return record_of(spark, folder).select("stage", F.to_json(F.struct("*")).alias("document"))


def record_sides(spark: SparkSession, folder: str) -> DataFrame:
    """What a model record says about its rows and baselines."""
    found = record_of(spark, folder).select(
        "stage",
        "raw_rows",
        "train_rows",
        "test_rows",
        F.col("regression.baseline_mae").alias("baseline_mae"),
        F.col("classification.baseline_accuracy").alias("baseline_accuracy"),
    )
    return rounded(found, ("baseline_mae", "baseline_accuracy"))


def holdout_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The hold-out of the completed-trip models, row by row, and whether both beat the baselines."""
    split = stage_split(spark, folder)
    models = searched(spark, folder, split)
    base = baseline_scores(split).first()
    fare, said = F.col("predicted_fare"), F.col("predicted_band")
    whole = models.predictions.agg(
        F.avg(F.abs(fare - F.col("fare_amt"))).alias("mae"),
        F.avg((said == F.col("band")).cast("double")).alias("accuracy"),
    ).first()
    return models.predictions.select(
        "row_id",
        F.round("fare_amt", 6).alias("fare_amt"),
        F.col("band").cast("int").alias("band"),
        F.lit(round(base["train_median"], 6)).alias("train_median"),
        F.lit(base["train_majority"]).alias("train_majority"),
        (fare.isNotNull() & said.isin(0.0, 1.0, 2.0)).alias("predicted"),
        F.lit(whole["mae"] < base["baseline_mae"]).alias("fare_beats_baseline"),
        F.lit(whole["accuracy"] > base["baseline_accuracy"]).alias("band_beats_baseline"),
    )


def cv_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The settings of both searches, and whether their means, deviations and ranks follow from the
    scores of the three folds."""
    found = cv_results(spark, folder)
    splits = F.array(*[F.col(f"split{k}_test_score") for k in range(3)])
    count = lambda a, x: a + x
    mean = F.aggregate(splits, F.lit(0.0), count) / 3
    squares = F.aggregate(F.transform(splits, lambda x: F.pow(x - mean, 2)), F.lit(0.0), count) / 3
    near = lambda a, b: F.abs(a - b) <= 1e-9 * (1 + F.abs(b))
    # A handful of settings for each task.
    order = F.when(F.col("task") == "regression", F.col("mean_test_score")).otherwise(-F.col("mean_test_score"))
    rank = F.rank().over(Window.partitionBy("task").orderBy(order))
    return found.select(
        "task",
        "setting",
        *[F.col(f"param_{name}") for name in ("max_depth", "learning_rate", "C")],
        F.size(F.filter(splits, lambda x: x.isNotNull())).alias("folds"),
        (near(mean, F.col("mean_test_score")) & near(F.sqrt(squares), F.col("std_test_score"))).alias("moments"),
        (rank == F.col("rank_test_score")).alias("ranked"),
    )


def stage_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each stage, and whether what is known after a trip makes its fare easier."""
    compared = stages(spark, folder)
    # One row for each stage.
    pickup = F.min(F.when(F.col("stage") == STAGES[0], F.col("rmse"))).over(Window.partitionBy())
    return compared.select(
        "stage", "train_rows", "test_rows", (F.col("rmse") <= pickup).alias("as_good_as_pickup")
    )


def stages(spark: SparkSession, folder: str) -> DataFrame:
    whole = prepared(trips(spark, folder), *MODEL_COLUMNS)
    compared = stage_comparison(whole, STAGES, fit=lambda split: searched(spark, folder, split))
    fare = [F.col(f"regression.{name}").alias(name) for name in ("rmse", "mae", "r2")]
    band = [F.col(f"classification.{name}").alias(name) for name in ("accuracy", "macro_f1")]
    return compared.select("stage", "train_rows", "test_rows", *fare, *band)


def fold_means(spark: SparkSession, folder: str) -> DataFrame:
    """A cross-validation table of deterministic scores, through CSV and back.

    The score of a setting on a fold is the mean fare of one event type among users of one
    remainder, so the table and its ranks can be checked.
    """
    events = table(spark, folder, "events").where(F.col("event_type").isNotNull())
    means = events.groupBy("event_type", (F.col("user_id") % 3).alias("fold")).agg(
        F.round(F.avg("value"), 6).alias("score")
    )
    # At most three rows for each event type.
    rows = means.orderBy("event_type", "fold").collect()
    names = sorted({row["event_type"] for row in rows})
    task = Task("regression", {"depth": tuple(range(len(names)))}, fit_fare, True)
    scores = [
        ("regression", names.index(r["event_type"]), {"depth": names.index(r["event_type"])}, r["fold"], r["score"])
        for r in rows
    ]
    found = cv_table(spark, scores, task)
    path = new_path(spark, "cv")
    write_csv(found, path)
    back = spark.read.schema(found.schema).option("header", True).csv(path)
    return rounded(back, [name for name, kind in back.dtypes if kind == "double"], 5)


FOLD_COLUMNS = ", ".join(
    f"round(max(score) FILTER (fold = {k}), 5) AS split{k}_test_score" for k in range(3)
)
FOLD_SQL = f"""WITH scores AS (
  SELECT event_type, user_id % 3 AS fold, round(avg(value), 6) AS score FROM events
  WHERE event_type IS NOT NULL GROUP BY ALL), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS setting FROM scores), summed AS (
  SELECT setting, {FOLD_COLUMNS}, avg(score) AS mean, stddev_pop(score) AS deviation
  FROM numbered GROUP BY setting)
SELECT 'regression' AS task, CAST(setting AS INTEGER) AS setting,
  CAST(setting AS DOUBLE) AS param_depth, split0_test_score, split1_test_score, split2_test_score,
  round(mean, 5) AS mean_test_score, round(deviation, 5) AS std_test_score,
  CAST(rank() OVER (ORDER BY mean) AS INTEGER) AS rank_test_score FROM summed"""


def position_sql(source: str, where: str = "") -> str:
    """Rows of ``source`` with ``in_train``, the side of the chronological split."""
    return f"""positions AS (
  SELECT *, row_number() OVER (ORDER BY pickup_datetime, row_id) - 1 AS position,
    count(*) OVER () AS n
  FROM {source} {where}), cut AS (
  SELECT pickup_datetime AS boundary FROM positions
  WHERE position = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)), sides AS (
  SELECT *, pickup_datetime < (SELECT boundary FROM cut) AS in_train FROM positions)"""


def scale_sql(name: str) -> tuple[str, str, str]:
    """Columns of the two fitting steps, and the scaled output."""
    median = f"coalesce(median({name}), 0) AS {name}_median"
    filled = f"coalesce({name}, {name}_median)"
    moments = f"avg({filled}) AS {name}_mean, stddev_pop({filled}) AS {name}_sd"
    spread = f"coalesce(nullif({name}_sd, 0), 1)"
    return median, moments, f"round(({filled} - {name}_mean) / {spread}, 6) AS {name}"


SCALES = [scale_sql(name) for name in NUMBERS]
SCALE_SQL = f"""WITH {SPARSE_SQL}, {position_sql("trips_sparse")}, medians AS (
  SELECT {", ".join(s[0] for s in SCALES)} FROM sides WHERE in_train), moments AS (
  SELECT {", ".join(s[1] for s in SCALES)} FROM sides, medians WHERE in_train)
SELECT row_id, {", ".join(s[2] for s in SCALES)} FROM sides, medians, moments"""

ZONE_SQL = f"""WITH {TIMED_SQL}, holed AS (
  SELECT * REPLACE (CASE WHEN passenger_count < 6 THEN pickup_zone END AS pickup_zone)
  FROM trips_timed), {position_sql("holed")}, favourite AS (
  SELECT pickup_zone AS most FROM sides WHERE in_train AND pickup_zone IS NOT NULL
  GROUP BY pickup_zone ORDER BY count(*) DESC, pickup_zone LIMIT 1), filled AS (
  SELECT row_id, in_train, coalesce(pickup_zone, (SELECT most FROM favourite)) AS zone
  FROM sides), categories AS (
  SELECT zone, CASE WHEN count(*) < 5 THEN 'infrequent' ELSE CAST(zone AS VARCHAR) END AS label
  FROM filled WHERE in_train GROUP BY zone)
SELECT row_id, 'pickup_zone' AS feature, label FROM filled LEFT JOIN categories USING (zone)"""

SLOT_SQL = ZONE_SQL.replace(
    "SELECT row_id, 'pickup_zone' AS feature, label FROM filled LEFT JOIN categories USING (zone)",
    """, slots AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS slot
    FROM (SELECT DISTINCT label FROM categories))
  SELECT row_id, slot, (SELECT CAST(count(*) AS INTEGER) FROM slots) AS width
  FROM filled LEFT JOIN categories USING (zone) LEFT JOIN slots USING (label)""",
)


def band_sql(column: str) -> str:
    return f"CAST(CASE WHEN {column} < 10 THEN 0 WHEN {column} < 25 THEN 1 ELSE 2 END AS INTEGER)"


MEANS_SQL = f"""means AS (
  SELECT user_id, event_type, round(avg(value), 9) AS predicted_fare FROM events GROUP BY ALL),
predicted AS (
  SELECT event_id AS row_id, value AS fare_amt, predicted_fare, {band_sql("value")} AS band,
    {band_sql("predicted_fare")} AS predicted_band
  FROM events JOIN means USING (user_id, event_type))"""
FARE_METRICS_SQL = """SELECT sqrt(avg((fare_amt - predicted_fare) ** 2)) AS rmse,
    avg(abs(fare_amt - predicted_fare)) AS mae,
    1 - sum((fare_amt - predicted_fare) ** 2) / (var_pop(fare_amt) * count(*)) AS r2
  FROM predicted"""
BAND_METRICS_SQL = """SELECT avg(CASE WHEN band = predicted_band THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM predicted), labels AS (
  SELECT band AS label FROM predicted UNION SELECT predicted_band FROM predicted), hits AS (
  SELECT label, count(*) FILTER (band = label AND predicted_band = label) AS hit,
    count(*) FILTER (band = label) AS actual, count(*) FILTER (predicted_band = label) AS claimed
  FROM predicted, labels GROUP BY label), macro AS (
  SELECT avg(CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END) AS macro_precision,
    avg(CASE WHEN actual > 0 THEN hit / actual ELSE 0 END) AS macro_recall,
    avg(2 * hit / (actual + claimed)) AS macro_f1
  FROM hits"""

QUERIES = {
    "ml_frame": Query(
        frame,
        f"""WITH {TRIPS_SQL}, {position_sql("trips", "WHERE fare_amt BETWEEN 0.01 AND 500")}
        SELECT CASE WHEN in_train THEN 'train' ELSE 'test' END AS role, row_id, pickup_datetime,
          fare_amt, passenger_count, CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour,
          CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS pickup_weekday,
          round(start_lon, 9) AS start_lon, round(start_lat, 9) AS start_lat, pickup_zone,
          trip_distance, round(end_lon, 9) AS end_lon, round(end_lat, 9) AS end_lat, dropoff_zone
        FROM sides""",
    ),
    "split_summary": Query(
        summary,
        f"""WITH {BOUNDARY_SQL}
        SELECT count(*) AS raw_rows, count(*) FILTER (pickup_datetime < boundary) AS train_rows,
          count(*) FILTER (pickup_datetime >= boundary) AS test_rows,
          max(pickup_datetime) FILTER (pickup_datetime < boundary) AS train_end,
          min(pickup_datetime) FILTER (pickup_datetime >= boundary) AS test_start
        FROM positions, cut""",
    ),
    "impute_scale": Query(scaled, SCALE_SQL),
    "impute_scale_search": Query(scaled_by_search, SCALE_SQL),
    "encode_zones": Query(zoned, ZONE_SQL),
    "encode_zone_slots": Query(zone_slots, SLOT_SQL),
    "regression_metrics": Query(
        fare_metrics,
        f"WITH {MEANS_SQL}, scores AS ({FARE_METRICS_SQL}) SELECT round(rmse, 6) AS rmse, "
        "round(mae, 6) AS mae, round(r2, 6) AS r2 FROM scores",
    ),
    "macro_metrics": Query(
        band_metrics,
        f"WITH {MEANS_SQL}, hit_rate AS ({BAND_METRICS_SQL}) "
        "SELECT round(CAST(accuracy AS DOUBLE), 6) AS accuracy, "
        "round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, "
        "round(macro_f1, 6) AS macro_f1 FROM hit_rate, macro",
    ),
    "confusion_matrix": Query(
        confusion,
        f"WITH {MEANS_SQL} SELECT band AS truth, predicted_band AS predicted, count(*) AS n "
        "FROM predicted GROUP BY ALL",
    ),
    "baseline_scores": Query(
        baselines,
        f"""WITH {TIMED_SQL}, {position_sql("trips_timed")}, banded AS (
            SELECT *, {band_sql("fare_amt")} AS band FROM sides), fitted AS (
            SELECT median(fare_amt) AS train_median,
              (SELECT band FROM banded WHERE in_train GROUP BY band
               ORDER BY count(*) DESC, band LIMIT 1) AS train_majority
            FROM banded WHERE in_train)
        SELECT round(train_median, 6) AS train_median, train_majority,
          round(avg(abs(fare_amt - train_median)), 6) AS baseline_mae,
          round(avg(CASE WHEN band = train_majority THEN CAST(1 AS DOUBLE) ELSE 0 END), 6)
            AS baseline_accuracy
        FROM banded, fitted WHERE NOT in_train GROUP BY train_median, train_majority""",
    ),
    "model_scores": Query(
        scores_of_documents,
        f"WITH {MEANS_SQL}, scores AS ({FARE_METRICS_SQL}), hit_rate AS ({BAND_METRICS_SQL}) "
        "SELECT 'events' AS dataset, 'pickup' AS stage, round(rmse, 6) AS rmse, "
        "round(mae, 6) AS mae, round(macro_f1, 6) AS macro_f1 FROM scores, macro",
    ),
    "fare_regression": Query(regression),
    "band_classification": Query(classification),
    "cv_results": Query(cv_results),
    "model_record": Query(record),
    "model_record_sides": Query(
        record_sides,
        f"""WITH {TRIPS_SQL}, {position_sql("trips", "WHERE fare_amt BETWEEN 0.01 AND 500")},
          banded AS (SELECT *, {band_sql("fare_amt")} AS band FROM sides), fitted AS (
          SELECT median(fare_amt) AS middle,
            (SELECT band FROM banded WHERE in_train GROUP BY band
             ORDER BY count(*) DESC, band LIMIT 1) AS most
          FROM banded WHERE in_train)
        SELECT 'completed-trip' AS stage, (SELECT count(*) FROM trips) AS raw_rows,
          count(*) FILTER (in_train) AS train_rows, count(*) FILTER (NOT in_train) AS test_rows,
          round(avg(abs(fare_amt - middle)) FILTER (NOT in_train), 6) AS baseline_mae,
          round(avg(CASE WHEN band = most THEN CAST(1 AS DOUBLE) ELSE 0 END)
            FILTER (NOT in_train), 6) AS baseline_accuracy
        FROM banded, fitted""",
    ),
    "holdout_scores": Query(
        holdout_scores,
        f"""WITH {TRIPS_SQL}, {position_sql("trips", "WHERE fare_amt BETWEEN 0.01 AND 500")},
          banded AS (SELECT *, {band_sql("fare_amt")} AS band FROM sides), fitted AS (
          SELECT round(median(fare_amt), 6) AS train_median,
            (SELECT band FROM banded WHERE in_train GROUP BY band
             ORDER BY count(*) DESC, band LIMIT 1) AS train_majority
          FROM banded WHERE in_train)
        SELECT row_id, round(fare_amt, 6) AS fare_amt, band, train_median, train_majority,
          true AS predicted, true AS fare_beats_baseline, true AS band_beats_baseline
        FROM banded, fitted WHERE NOT in_train""",
    ),
    "cv_settings": Query(
        cv_settings,
        """WITH grid AS (
          SELECT 'regression' AS task, CAST(depth AS DOUBLE) AS param_max_depth,
            CAST(rate AS DOUBLE) AS param_learning_rate, CAST(NULL AS DOUBLE) AS param_C
          FROM (SELECT unnest([3, 5]) AS depth), (SELECT unnest([0.05, 0.15]) AS rate)
          UNION ALL SELECT 'classification', NULL, NULL, CAST(c AS DOUBLE)
          FROM (SELECT unnest([0.1, 1.0, 10.0]) AS c))
        SELECT task, CAST(row_number() OVER (PARTITION BY task
            ORDER BY param_learning_rate, param_max_depth, param_C) - 1 AS INTEGER) AS setting,
          param_max_depth, param_learning_rate, param_C, 3 AS folds, true AS moments, true AS ranked
        FROM grid""",
    ),
    "stage_sides": Query(
        stage_sides,
        f"""WITH {TRIPS_SQL}, {position_sql("trips", "WHERE fare_amt BETWEEN 0.01 AND 500")},
          stages AS (SELECT unnest(['pickup', 'completed-trip']) AS stage)
        SELECT stage, count(*) FILTER (in_train) AS train_rows,
          count(*) FILTER (NOT in_train) AS test_rows, true AS as_good_as_pickup
        FROM sides, stages GROUP BY stage""",
    ),
    "cv_table_csv": Query(fold_means, FOLD_SQL),
    "stage_comparison": Query(stages),
}
