"""Joins whose keys may be hot on one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.session import localised, written

#: Keys with more rows than this are joined apart.
CROWD = 10_000


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """``rows`` with the columns that ``table`` has for their keys; rows without an entry go.

    ``table`` holds each key once, none of them null. Keys that more than ``crowd`` rows have are
    few, at most one for each ``crowd`` rows: their entries are sent to every task if they prove
    small. The other rows and entries are shuffled, and no key brings more than ``crowd`` rows.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > crowd)
    hot = written(table.join(counted.drop("rows"), keys), "hot")
    if hot.isEmpty():
        return rows.join(table, keys)
    hot = localised(hot)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table, keys))
