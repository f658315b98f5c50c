"""Cleaning, time features, chronological hold-out and expanding folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions.trips import pickup_hour, pickup_weekday
from fareline.operators.order_stats import order_statistics, row_positions
from fareline.operators.sampling import budget_sample
from fareline.session import written
from fareline.sources.trips import MOMENT, as_moment

# Valid fares, the share of rows before the hold-out, the least split sizes, and the
# columns a model may see at pickup and, in addition, after the trip.
FARE_RANGE = (0.01, 500.0)
TRAIN_SHARE = 0.8
LEAST_TRAIN, LEAST_TEST = 300, 50
PICKUP_FEATURES = (
    "passenger_count",
    "pickup_hour",
    "pickup_weekday",
    "start_lon",
    "start_lat",
    "pickup_zone",
)
COMPLETED_FEATURES = ("trip_distance", "end_lon", "end_lat", "dropoff_zone")
STAGES = ("pickup", "completed-trip")
# Columns that would give the answer away at pickup.
LEAKAGE = ("fare_amt", "tip_amt", *COMPLETED_FEATURES)

SAMPLE_SEED = 42


def clean_fares(df: DataFrame) -> DataFrame:
    """Trips with a valid fare and a known pickup time."""
    moment = as_moment(MOMENT, df.schema[MOMENT].dataType)
    valid = F.col("fare_amt").between(*FARE_RANGE) & F.col(MOMENT).isNotNull()
    return df.withColumn(MOMENT, moment).where(valid)


def with_time_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"pickup_hour": pickup_hour(MOMENT), "pickup_weekday": pickup_weekday(MOMENT)}
    )


def stage_features(columns: Sequence[str], stage: str = "pickup") -> list[str]:
    """Features a stage may use, as far as the table has them."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    allowed = PICKUP_FEATURES + (COMPLETED_FEATURES if stage == "completed-trip" else ())
    return [name for name in allowed if name in columns]


def time_ordered(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows by pickup time; ``key`` settles ties, since Spark's sort is not stable."""
    return df.orderBy(MOMENT, key)


@dataclass(frozen=True)
class Split:
    """Chronological hold-out. ``boundary`` is the first pickup time of the test side."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    stage: str
    train_rows: int
    test_rows: int
    boundary: Column
    #: The rows of both sides, and those without a pickup time.
    source: DataFrame


def chronological_split(
    df: DataFrame, features: Sequence[str] = (), stage: str = "pickup"
) -> Split:
    """Train strictly before the time at position int(0.8 n), test from it on; ties go to test.

    The position is found by counting passes; the split itself is two filters that reach the scan.
    """

    def cut(rows: int) -> list[int]:
        return [int(rows * TRAIN_SHARE)] if rows else []

    times = order_statistics(df, MOMENT, cut)
    if not times.rows:
        raise ValueError("no rows to split")
    rank = cut(times.rows)[0]
    boundary = times.literal(rank)
    before = times.at[rank].below
    return Split(
        df.where(F.col(MOMENT) < boundary),
        df.where(F.col(MOMENT) >= boundary),
        list(features),
        stage,
        before,
        times.rows - before,
        boundary,
        df,
    )


def ml_frame(
    df: DataFrame, max_rows: int | None = None, stage: str = "pickup", key: str = "row_id"
) -> Split:
    """Clean, sample to the row budget, add features and split chronologically.

    The boundary search, the folds and every fit read the result again: ``df`` should be a table,
    not an expensive plan. A budget sample is written once for that reason.
    """
    clean = with_time_features(clean_fares(df))
    features = stage_features(clean.columns, stage)
    narrow = clean.select(key, MOMENT, "fare_amt", *features)
    if max_rows is not None:
        narrow = written(budget_sample(narrow, max_rows, SAMPLE_SEED, key), "budget")
    split = chronological_split(narrow, features, stage)
    if split.train_rows < LEAST_TRAIN or split.test_rows < LEAST_TEST:
        raise ValueError("not enough rows for a chronological evaluation")
    return split


def split_summary(df: DataFrame, split: Split) -> DataFrame:
    """Raw rows, and rows and time bounds of the split, in one aggregate over the stacked rows."""
    in_train = F.col(MOMENT) < split.boundary
    rows = split.source.select(MOMENT, F.lit(False).alias("_raw"))
    raw = df.select(F.lit(None).cast(split.source.schema[MOMENT].dataType).alias(MOMENT))
    stacked = rows.unionByName(raw.withColumn("_raw", F.lit(True)))
    return stacked.agg(
        F.count_if(F.col("_raw")).alias("raw_rows"),
        F.count_if(in_train).alias("train_rows"),
        F.count_if(~in_train).alias("test_rows"),
        F.max(F.when(in_train, F.col(MOMENT))).alias("train_end"),
        F.min(F.when(~in_train, F.col(MOMENT))).alias("test_start"),
    )


@dataclass(frozen=True)
class Fold:
    number: int
    train: Column
    test: Column


def fold_starts(rows: int, n_splits: int = 3) -> list[int]:
    """Positions at which the test parts start; the first training part takes the rest."""
    part = rows // (n_splits + 1)
    if part == 0:
        raise ValueError("too few rows for the folds")
    return [rows - (n_splits - number) * part for number in range(n_splits)]


def chronological_folds(df: DataFrame, n_splits: int = 3, key: str = "row_id") -> list[Fold]:
    """Expanding folds as row conditions.

    A test part is a range of positions in (time, key) order. Its training part is every row whose
    time is strictly before the first test time, so rows tied with it belong to neither side.
    """
    _, starts = row_positions(df, MOMENT, key, lambda rows: fold_starts(rows, n_splits))
    folds = []
    for number, start in enumerate(starts):
        test = start.starts_at(MOMENT, key)
        if number + 1 < len(starts):
            test = test & ~starts[number + 1].starts_at(MOMENT, key)
        folds.append(Fold(number, F.col(MOMENT) < start.first, test))
    return folds


def expanding_folds(df: DataFrame, n_splits: int = 3, key: str = "row_id") -> DataFrame:
    """Fold membership as a table (fold, role, key). One pass; a row may serve in several folds."""
    roles = []
    for fold in chronological_folds(df, n_splits, key):
        role = F.when(fold.train, "train").when(fold.test, "test")
        roles.append(F.struct(F.lit(fold.number).alias("fold"), role.alias("role")))
    members = df.select(key, F.inline(F.array(*roles))).where(F.col("role").isNotNull())
    return members.select("fold", "role", key)
