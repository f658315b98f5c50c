"""Tolerant comparison of two keyed tables, itself a Spark job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tolerances of the correctness gate.
RTOL = 1e-5
ATOL = 1e-8

SIDES = ("actual", "expected")


def close(actual: Column, expected: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Within the tolerance; an infinity is close to itself only."""
    infinite = F.lit(float("inf"))
    finite = (F.abs(actual) < infinite) & (F.abs(expected) < infinite)
    near = F.abs(actual - expected) <= F.lit(atol) + F.lit(rtol) * F.abs(expected)
    return F.when(finite, near).otherwise(actual == expected)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def comparable(df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    kinds = {field.name: field.dataType for field in df.schema.fields}

    def value(name: str) -> Column:
        if not is_number(kinds[name]):
            return F.col(name)
        number = F.col(name).cast("double")
        return F.nanvl(number, F.lit(None).cast("double")).alias(name)

    return df.select(*keys, *[value(name) for name in columns], F.lit(side).alias("_side"))


def tolerant_diff(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    rtol: float = RTOL,
    atol: float = ATOL,
) -> DataFrame:
    """One row per differing cell: keys, column, reason, actual, expected.

    Reasons: ``missing`` and ``extra`` (key on one side only), ``duplicate`` (key more than once on
    a side), ``null`` (value on one side only), ``value`` (outside the tolerance). Missing equals
    missing, NaN counts as missing, numeric types are interchangeable, other types compare exactly.

    Both sides are stacked and grouped by key: one shuffle with map-side combine. A key that is
    repeated any number of times is one partial row per task, and is never paired with itself.
    """
    keys = list(keys)
    columns = [name for name in expected.columns if name not in keys]
    if sorted(actual.columns) != sorted(expected.columns):
        raise ValueError(f"columns differ: {sorted(actual.columns)}, {sorted(expected.columns)}")
    stacked = comparable(actual, keys, columns, SIDES[0]).unionByName(
        comparable(expected, keys, columns, SIDES[1])
    )

    def of_side(name: str, side: str) -> Column:
        return F.first(F.when(F.col("_side") == side, F.col(name)), ignorenulls=True)

    counts = [
        F.count(F.when(F.col("_side") == side, 1)).alias(f"_{side}_rows") for side in SIDES
    ]
    values = [
        of_side(name, side).alias(f"_{side}_{number}")
        for number, name in enumerate(columns)
        for side in SIDES
    ]
    paired = stacked.groupBy(*keys).agg(*counts, *values)

    n_actual, n_expected = F.col("_actual_rows"), F.col("_expected_rows")
    row_reason = (
        F.when((n_actual > 1) | (n_expected > 1), "duplicate")
        .when(n_actual == 0, "missing")
        .when(n_expected == 0, "extra")
    )
    numeric = {field.name: is_number(field.dataType) for field in expected.schema.fields}
    no_number = F.lit(None).cast("double")

    def cell(number: int, name: str) -> Column:
        a, b = F.col(f"_actual_{number}"), F.col(f"_expected_{number}")
        same = close(a, b, rtol, atol) if numeric[name] else a == b
        reason = F.when(a.isNull() != b.isNull(), "null").when(~same, "value")
        return F.struct(
            F.lit(name).alias("column"),
            reason.alias("reason"),
            (a if numeric[name] else no_number).alias("actual"),
            (b if numeric[name] else no_number).alias("expected"),
        )

    row_cell = F.struct(
        F.lit(None).cast("string").alias("column"),
        row_reason.alias("reason"),
        no_number.alias("actual"),
        no_number.alias("expected"),
    )
    cells = F.array(*[cell(number, name) for number, name in enumerate(columns)])
    found = F.when(row_reason.isNotNull(), F.array(row_cell))
    if columns:
        found = found.otherwise(F.filter(cells, lambda item: item["reason"].isNotNull()))
    return paired.select(*keys, F.inline(found))


#: Parts of the key space that have a checksum of their own.
BUCKETS = 4096


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def bucket_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and two order-free checksums of each bucket, over keys and values as they compare."""
    rows = comparable(df, keys, columns, "")
    kinds = dict(rows.dtypes)
    # Zero has two signs but is one value.
    values = [
        F.when(F.col(name) == 0, F.lit(0.0)).otherwise(F.col(name)) if kinds[name] == "double" else F.col(name)
        for name in columns
    ]
    # Missing values leave a hash as it is, so a mark for each says where they are.
    absent = F.concat(*[F.col(name).isNull().cast("string") for name in columns]) if columns else F.lit("")
    digest = F.xxhash64(*keys, *values, absent)
    return rows.select(bucket_of(keys).alias("bucket"), digest.alias("digest")).groupBy("bucket").agg(
        F.count("*").alias("rows"),
        F.bit_xor("digest").alias("either"),
        F.sum(F.shiftright("digest", 32)).alias("total"),
    )


def tolerant_diff_of_unique(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    rtol: float = RTOL,
    atol: float = ATOL,
) -> DataFrame:
    """:func:`tolerant_diff` of tables whose keys are known to be unique on each side.

    Buckets of the keys are compared by checksum first, one partial row for each bucket and task.
    Only rows of buckets that differ are shuffled, none at all if the tables are equal. Keys that
    are not unique after all are named if their bucket differs. Columns of other types than numbers
    must be of a type that can be hashed.
    """
    keys = list(keys)
    columns = [name for name in expected.columns if name not in keys]
    if sorted(actual.columns) != sorted(expected.columns):
        raise ValueError(f"columns differ: {sorted(actual.columns)}, {sorted(expected.columns)}")
    sums = [bucket_sums(df, keys, columns) for df in (actual, expected)]
    both = sums[0].unionByName(sums[1])
    differing = both.groupBy("bucket").agg(
        F.count("*").alias("sides"),
        *[(F.min(name) != F.max(name)).alias(f"{name}_differ") for name in ("rows", "either", "total")],
    )
    differing = differing.where("sides < 2 OR rows_differ OR either_differ OR total_differ")
    # At most one number for each bucket.
    found = sorted(row["bucket"] for row in differing.select("bucket").collect())
    parts = [df.where(bucket_of(keys).isin(found)) if found else df.limit(0) for df in (actual, expected)]
    return tolerant_diff(*parts, keys, rtol, atol)


def assert_matches(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    rtol: float = RTOL,
    atol: float = ATOL,
) -> None:
    """Raise if the tables differ, naming the first few differing cells."""
    try:
        examples = tolerant_diff(actual, expected, keys, rtol, atol).limit(5).collect()
    except ValueError as problem:
        raise AssertionError(str(problem)) from problem
    if examples:
        raise AssertionError(f"tables differ, for example: {examples}")
