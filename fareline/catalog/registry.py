"""A registered query."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """Spark job over the tables of a folder and, where SQL can express it, the same in SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    """Engines differ in the last bits of double aggregates, so both sides round them."""
    return df.withColumns({name: F.round(name, digits) for name in names})


def value(name: str = "value", digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)
