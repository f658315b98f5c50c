"""Reproducible random samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.operators.ranking import priority_threshold, ranked_by_priority, with_identity

# Labels of the nested samples, smallest first.
SAMPLE_LABELS = ("small", "medium", "large")


def checked_sizes(sizes: Sequence[int]) -> tuple[int, ...]:
    sizes = tuple(sizes)
    rising = all(a < b for a, b in zip(sizes, sizes[1:], strict=False))
    if len(sizes) != len(SAMPLE_LABELS) or not rising or sizes[0] < 1:
        raise ValueError("sizes must be three strictly increasing positive numbers")
    return sizes


def priority_sample(
    df: DataFrame, size: int, seed: int = 42, key: Column | str = "row_id", name: str = "row_id"
) -> DataFrame:
    """Uniform sample of ``size`` rows, numbered in the order of their priority."""
    return ranked_by_priority(df, size, seed, key, name)


def nested_samples(
    df: DataFrame,
    sizes: Sequence[int],
    seed: int = 42,
    key: Column | str = "row_id",
    name: str = "row_id",
) -> DataFrame:
    """The largest sample, each row labelled with the smallest sample that holds it.

    Samples are prefixes of one order, so the medium sample is the rows labelled small or medium.
    """
    sizes = checked_sizes(sizes)
    sample = ranked_by_priority(df, sizes[-1], seed, key, name)
    label = F.when(F.col(name) < sizes[0], SAMPLE_LABELS[0])
    for size, text in zip(sizes[1:], SAMPLE_LABELS[1:], strict=True):
        label = label.when(F.col(name) < size, text)
    return sample.withColumn("sample", label)


def budget_sample(
    df: DataFrame, max_rows: int, seed: int = 42, key: Column | str = "row_id"
) -> DataFrame:
    """All rows if there are at most ``max_rows``, else a uniform sample of that many.

    The sample is every row whose priority is at most a threshold: a filter of the scan, without a
    shuffle. ``key`` must identify a row; of rows equal in it, as many stay as fit.
    """
    if max_rows < 1:
        raise ValueError("the row budget must be positive")
    key = F.col(key) if isinstance(key, str) else key
    found = priority_threshold(df, max_rows, seed, key)
    if found is None:
        return df
    limit, below, same = found
    drawn = with_identity(df, key, seed)
    if below + same <= max_rows:
        return drawn.where(F.col("_priority") <= limit).select(*df.columns)
    under = drawn.where(F.col("_priority") < limit)
    tied = drawn.where(F.col("_priority") == limit).limit(max_rows - below)
    return under.unionByName(tied).select(*df.columns)
