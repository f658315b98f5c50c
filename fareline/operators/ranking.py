"""Dense positions over whole tables without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.functions.draws import priority
from fareline.functions.trips import axis_literal, axis_value

# Leading hexadecimal digits of the priority that make a bucket: 65,536 buckets of equal share.
BUCKET_DIGITS = 4
# Priorities of one open prefix that may come back to the driver.
FEW_PRIORITIES = 4096
# Low bits of a monotonically increasing id that count the rows of one partition.
ROW_BITS = 33
# Drawn rows for each partition from which its bounds are taken.
ROWS_PER_BOUND = 64


def with_identity(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """``df`` with ``_key``, the text that tells a row apart, and its ``_priority``.

    Rows without a key are told apart by all their columns. They are a branch of their own, so that
    the others read the key alone, and that branch reads no row group without a missing key.
    """
    whole = F.concat_ws("|", F.lit("missing"), F.xxhash64(*df.columns))
    known = df.where(key.isNotNull()).withColumn("_key", key.cast("string"))
    other = df.where(key.isNull()).withColumn("_key", whole)
    both = known.unionByName(other)
    return both.withColumn("_priority", priority(F.col("_key"), seed))


def priority_threshold(
    df: DataFrame, size: int, seed: int = 42, key: Column | str = "row_id"
) -> tuple[str, int, int] | None:
    """The largest priority among the ``size`` least, the rows below it, and the rows that have it.

    ``None`` if there are no more rows than ``size``. Counts by the priority's leading digits, over
    the key column alone, tell which prefix holds it; the search goes on within the prefix until
    few priorities are left.
    """
    key = F.col(key) if isinstance(key, str) else key
    drawn = with_identity(df, key, seed).select("_priority")
    prefix, below = "", 0
    while True:
        inside = drawn.where(F.col("_priority").startswith(prefix)) if prefix else drawn
        digits = F.substring("_priority", 1, len(prefix) + BUCKET_DIGITS)
        counts = inside.groupBy(digits.alias("digits")).agg(F.count("*").alias("n"))
        rows = sorted((row["digits"], row["n"]) for row in counts.collect())
        if not prefix and sum(n for _, n in rows) <= size:
            return None
        for digits_found, n in rows:
            if below + n >= size:
                prefix = digits_found
                break
            below += n
        last = len(prefix) == 32
        if not last and n > FEW_PRIORITIES:
            continue
        if last:
            return prefix, below, n
        left = drawn.where(F.col("_priority").startswith(prefix))
        values = sorted(row["_priority"] for row in left.collect())
        limit = values[size - below - 1]
        return limit, below + values.index(limit), values.count(limit)


def ranked_by_priority(
    df: DataFrame,
    size: int | None = None,
    seed: int = 42,
    key: Column | str = "row_id",
    name: str = "row_id",
) -> DataFrame:
    """The ``size`` rows of least random priority (all rows if ``None``), numbered from 0.

    ``key`` must identify a row. The leading digits of the priority are a bucket; bucket sizes
    (at most 65,536 numbers, one aggregation over the key column alone) give the first number of
    every bucket, and rows are numbered inside their bucket. Buckets that start at or after ``size``
    are dropped before the shuffle, so about ``size`` rows move. Buckets are equally likely by
    construction: there is no hot one.
    """
    key = F.col(key) if isinstance(key, str) else key
    drawn = with_identity(df, key, seed)
    digits = F.substring("_priority", 1, BUCKET_DIGITS)
    # Never NULL, and declared so: a nullable join key would be computed once more in a filter.
    bucket = F.coalesce(F.conv(digits, 16, 10).cast("int"), F.lit(0))
    drawn = drawn.withColumn("_bucket", bucket)
    sizes = drawn.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    starts = sizes.select("_bucket", before.alias("_start"))
    if size is not None:
        starts = starts.where(F.col("_start") < size)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_priority", "_key"))
    rank = F.col("_start") + inside - 1
    ranked = drawn.join(F.broadcast(starts), "_bucket").withColumn("_rank", rank)
    if size is not None:
        ranked = ranked.where(F.col("_rank") < size)
    kept = [column for column in df.columns if column != name]
    return ranked.select(F.col("_rank").alias(name), *kept)


def bound_literal(value, kind: T.DataType) -> Column:
    """Literal of an order column's value as :func:`bound_value` brought it to the driver."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType, T.IntegralType)):
        return axis_literal(value, kind).cast(kind)
    return F.lit(value).cast(kind)


def bound_value(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return axis_value(name, kind).alias(name)
    return F.col(name)


def drawn_bounds(df: DataFrame, order: Sequence[str], parts: int) -> list[Column]:
    """Lower bounds of all parts but the first, as literals.

    They come from the rows of least hash of their order columns, ``ROWS_PER_BOUND`` for each part,
    so they are the same whenever they are drawn.
    """
    kinds = [df.schema[name].dataType for name in order]
    values = [bound_value(name, kind) for name, kind in zip(order, kinds, strict=True)]
    least = df.orderBy(F.xxhash64(*order), *order).limit(parts * ROWS_PER_BOUND)
    rows: list[Row] = least.orderBy(*order).select(*values).collect()
    picked = [rows[k * len(rows) // parts] for k in range(1, parts)] if rows else []
    distinct = list(dict.fromkeys(tuple(row) for row in picked))
    return [
        F.struct(*[bound_literal(v, kind).alias(n) for v, kind, n in zip(row, kinds, order, strict=True)])
        for row in distinct
    ]


def part_of(row: Column, bounds: Sequence[Column]) -> Column:
    """How many bounds a row reaches, by halving."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        upper = F.when(row >= bounds[middle - 1], search(middle, high))
        return upper.otherwise(search(low, middle - 1))

    return search(0, len(bounds))


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Every row with its 0-based position in ``order``, whose columns together are unique.

    The rows are dealt to parts by bounds over all order columns, so ties of the leading column, even
    a third of all rows, spread. The bounds are literals of the plan: a recomputed part holds the
    same rows, and nothing is written. One count, over the order columns alone, tells where each
    part starts; one shuffle and a sort within the parts number the rows.
    """
    order = list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = drawn_bounds(df, order, parts)
    part = part_of(F.struct(*order), bounds)
    sizes = dict.fromkeys(range(len(bounds) + 1), 0)
    for row in df.select(part.alias("_part")).groupBy("_part").agg(F.count("*").alias("n")).collect():
        sizes[row["_part"]] = row["n"]
    starts = [sum(sizes[k] for k in range(number)) for number in sizes]
    dealt = df.withColumn("_part", part).repartitionById(len(sizes), F.col("_part"))
    inside = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    ordered = dealt.sortWithinPartitions(*order)
    start = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("_part"))
    return ordered.select((start + inside).alias(name), *df.columns)
