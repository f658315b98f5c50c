"""Exact order statistics by radix selection, without a sort of rows.

Every value has an ordinal, a 64-bit integer that orders like it: the value itself for integers and
times, and for doubles the bits of the magnitude with the sign of the value, so that 0.0 and -0.0
are one. A rank is found digit by digit. A counting pass (one aggregation with map-side combine)
groups the ordinals of the open range by their next 16 bits; running sums over at most 65,537 counts
tell which digit holds the rank, and its smallest and largest ordinal are the next range. So 64 bits
take four passes at most, whatever the data, and no task and no driver ever holds the values
themselves.

Medians of groups come from one aggregation whose buffers are multisets (a count for each value of
the group, merged on the map side). Groups too large for a buffer are searched digit by digit in the
same way, all of them in the same four passes.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.functions.trips import axis_literal, axis_value
from fareline.session import discard, localised, settled, written

#: Bits of an ordinal that one pass settles.
DIGIT = 16
LARGEST = sys.float_info.max
LEAST_NORMAL = sys.float_info.min
FRACTION_BITS, EXPONENT_BIAS = 52, 1023
INFINITE = 0x7FF << FRACTION_BITS
#: Twice this scale turns the least positive double into 1.
HALF_SCALE = 2.0**537
#: Groups with more rows are searched digit by digit; smaller ones are multisets in a buffer.
GROUP_ROWS = 10_000


def ordinal_of(value: int | float, kind: T.DataType) -> int:
    if not isinstance(kind, T.FractionalType):
        return value
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def value_of(ordinal: int, kind: T.DataType) -> int | float:
    if not isinstance(kind, T.FractionalType):
        return ordinal
    value = struct.unpack("<d", struct.pack("<q", abs(ordinal)))[0]
    return -value if ordinal < 0 else value


def with_ordinal(frame: DataFrame, kind: T.DataType) -> DataFrame:
    """``_ordinal`` of the numbers in ``_axis``, as :func:`ordinal_of`.

    Spark has no function for the bits of a double, so they are computed: the exponent from a
    logarithm, mended by one where that is rounded, and the fraction by a division that is exact.
    """
    if not isinstance(kind, T.FractionalType):
        return frame.withColumn("_ordinal", F.col("_axis"))
    size = F.abs("_axis")
    normal = F.when(size.between(LEAST_NORMAL, LARGEST), size).otherwise(1.0)
    # Separate steps, so that each is computed once for a row.
    steps = frame.withColumn("_guess", F.floor(F.log2(normal)))
    steps = steps.withColumn("_power", F.pow(F.lit(2.0), F.col("_guess")))
    power = F.col("_power")
    mended = F.when(power > normal, -1).when(power <= normal / 2, 1).otherwise(0)
    steps = steps.withColumn("_exponent", F.col("_guess") + mended)
    fraction = size / F.pow(F.lit(2.0), F.col("_exponent")) - 1
    bits = (F.col("_exponent") + EXPONENT_BIAS) * F.lit(1 << FRACTION_BITS) + (
        fraction * float(1 << FRACTION_BITS)
    ).cast("bigint")
    small = (size * HALF_SCALE * HALF_SCALE).cast("bigint")
    whole = F.when(size > LARGEST, INFINITE).when(size < LEAST_NORMAL, small).otherwise(bits)
    signed = F.when(F.col("_axis") < 0, -whole).otherwise(whole)
    return steps.withColumn("_ordinal", signed).drop("_guess", "_power", "_exponent")


@dataclass
class Range:
    """Open search: ``ranks`` lie among the values whose ordinals are ``low`` to ``high``.

    ``below`` rows of the group lie under ``low``.
    """

    group: tuple
    low: int
    high: int
    below: int
    ranks: list[int]

    @property
    def shift(self) -> int:
        """Bits below the digit that the next pass counts."""
        return max((self.high - self.low).bit_length() - DIGIT, 0)


@dataclass(frozen=True)
class Found:
    """Value at a rank, and how many rows of its group are strictly smaller."""

    value: int | float
    below: int


@dataclass
class Search:
    kind: T.DataType
    open: list[Range] = field(default_factory=list)
    found: dict[tuple, dict[int, Found]] = field(default_factory=dict)

    def add(self, part: Range) -> None:
        if part.low == part.high:
            answers = self.found.setdefault(part.group, {})
            value = value_of(part.low, self.kind)
            answers.update({rank: Found(value, part.below) for rank in part.ranks})
        else:
            self.open.append(part)


def digit_counts(frame: DataFrame, search: Search) -> DataFrame:
    """Rows of each digit of the open ranges, with the digit's smallest and largest ordinal."""
    ranges = search.open
    bounds = [F.array(*[F.lit(getattr(part, end)) for part in ranges]) for end in ("low", "high")]
    shift = F.get(F.array(*[F.lit(part.shift) for part in ranges]), F.col("_range"))
    low, high = (F.get(bound, F.col("_range")) for bound in bounds)
    rows = with_ordinal(frame, search.kind)
    digit = F.call_function("shiftright", F.col("_ordinal"), shift).alias("_digit")
    # No filter by the ordinal: Spark would push it below the computation and repeat that in it.
    inside = F.when(F.col("_ordinal").between(low, high), F.col("_ordinal"))
    counts = rows.groupBy("_range", digit).agg(
        F.count(inside).alias("n"), F.min(inside).alias("low"), F.max(inside).alias("high")
    )
    return counts.where("n > 0")


def histogram(frame: DataFrame, search: Search) -> list:
    """One counting pass over a frame with ``_range`` and ``_axis``: for each rank of the open
    ranges, the digit that holds it, with its bounds and the rows of the range below it."""
    ranges = search.open
    spark = frame.sparkSession
    counts = digit_counts(frame, search)
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy("_digit"))
    wanted = [(i, rank - part.below) for i, part in enumerate(ranges) for rank in part.ranks]
    asked = F.broadcast(spark.createDataFrame(wanted, "_range int, rank long"))
    placed = counts.withColumn("upto", upto).join(asked, "_range")
    holds = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    chosen = placed.where(holds).select("_range", "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below"))
    return chosen.collect()


def narrowed(search: Search, rows: list) -> Search:
    """Next state of the search from the digits that hold its ranks."""
    following = Search(search.kind, found=search.found)
    settled_ranks = 0
    parts: dict[tuple, Range] = {}
    for row in rows:
        old = search.open[row["_range"]]
        below = old.below + row["below"]
        part = Range(old.group, row["low"], row["high"], below, [])
        parts.setdefault((row["_range"], row["low"]), part).ranks.append(row["rank"] + old.below)
        settled_ranks += 1
    if settled_ranks < sum(len(part.ranks) for part in search.open):
        raise ValueError("some ranks lie outside their group")
    for part in parts.values():
        following.add(part)
    return following


def refined(search: Search, step: Callable[[Search], list]) -> dict:
    """Run ``step`` (search -> digits that hold the ranks) until every rank is settled."""
    while search.open:
        search = narrowed(search, step(search))
    return search.found


def chosen_of(hits: list[Column], values: list[Column]) -> Column:
    pairs = list(zip(hits, values, strict=True))
    return reduce(lambda chain, pair: chain.when(*pair), pairs[1:], F.when(*pairs[0]))


def labelled(df: DataFrame, column: str, search: Search, scope: Callable) -> DataFrame:
    """Rows of ``df`` that fall into an open range, by literal conditions that reach the scan."""
    kind = search.kind
    typed = F.col(column)
    hits = [
        scope(part.group)
        & typed.between(
            axis_literal(value_of(part.low, kind), kind),
            axis_literal(value_of(part.high, kind), kind),
        )
        for part in search.open
    ]
    return df.where(reduce(lambda a, b: a | b, hits)).select(
        chosen_of(hits, [F.lit(number) for number in range(len(hits))]).alias("_range"),
        axis_value(column, kind).alias("_axis"),
    )


@dataclass(frozen=True)
class OrderStatistics:
    """Result for one column: the number of non-missing rows and the values at the asked ranks."""

    rows: int
    kind: T.DataType
    at: dict[int, Found]

    def literal(self, rank: int) -> Column:
        return axis_literal(self.at[rank].value, self.kind)


def order_statistics(
    df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]]
) -> OrderStatistics:
    """Values of ``column`` at 0-based ranks; ``ranks`` receives the number of non-missing rows."""
    kind = df.schema[column].dataType
    typed = axis_value(column, kind) if isinstance(kind, T.FractionalType) else F.col(column)
    ends = df.agg(F.count(typed).alias("n"), F.min(typed).alias("low"), F.max(typed).alias("high"))
    rows, low, high = ends.select("n", axis_value("low", kind), axis_value("high", kind)).first()
    search = Search(kind)
    wanted = sorted(set(ranks(rows)))
    if wanted:
        search.add(Range((), ordinal_of(low, kind), ordinal_of(high, kind), 0, wanted))
    known = df.where(F.col(column).isNotNull())

    def step(now: Search) -> list:
        return histogram(labelled(known, column, now, lambda group: F.lit(True)), now)

    return OrderStatistics(rows, kind, refined(search, step).get((), {}))


@dataclass(frozen=True)
class Position:
    """First and second order column of the row at a position."""

    first: Column
    second: Column

    def starts_at(self, first: str, second: str) -> Column:
        """Rows from this position on."""
        tied = (F.col(first) == self.first) & (F.col(second) >= self.second)
        return (F.col(first) > self.first) | tied


def row_positions(
    df: DataFrame, first: str, second: str, ranks: Callable[[int], Sequence[int]]
) -> tuple[int, list[Position]]:
    """Rows at positions of the order (``first``, ``second``), as comparable literals.

    Ties of ``first`` are settled by a second search among the tied rows only, so a value of
    ``first`` shared by a large part of the table costs one more narrow pass.
    """
    outer = order_statistics(df, first, ranks)
    wanted = list(ranks(outer.rows))
    kind = df.schema[second].dataType
    axis = axis_value(second, kind)
    tied_values = sorted({outer.at[rank].value for rank in wanted})
    if not tied_values:
        return outer.rows, []
    literals = {value: axis_literal(value, outer.kind) for value in tied_values}

    def scope(group: tuple) -> Column:
        return F.col(first) == literals[group[0]]

    tied = df.where(reduce(lambda a, b: a | b, [scope((value,)) for value in tied_values]))
    bounds = tied.groupBy(axis_value(first, outer.kind).alias("_tie")).agg(
        F.count(axis).alias("n"), F.min(axis).alias("low"), F.max(axis).alias("high")
    )
    search = Search(kind)
    for row in bounds.collect():
        inner = [r - outer.at[r].below for r in wanted if outer.at[r].value == row["_tie"]]
        low, high = ordinal_of(row["low"], kind), ordinal_of(row["high"], kind)
        search.add(Range((row["_tie"],), low, high, 0, sorted(set(inner))))

    def step(now: Search) -> list:
        return histogram(labelled(tied, second, now, scope), now)

    found = refined(search, step)
    positions = []
    for rank in wanted:
        hit = outer.at[rank]
        inside = found[(hit.value,)][rank - hit.below]
        positions.append(Position(literals[hit.value], axis_literal(inside.value, kind)))
    return outer.rows, positions


def middle_ranks(rows: int) -> list[int]:
    """Ranks whose values average to the median."""
    return [(rows - 1) // 2, rows // 2] if rows else []


def middle(found: dict[int, Found], rows: int) -> float | None:
    """Mean of the middle values; halves first, so that large ones don't overflow."""
    values = [found[rank].value for rank in middle_ranks(rows)]
    return values[0] / 2 + values[1] / 2 if values else None


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each numeric column; a column without values yields ``None``.

    All columns share every pass, so the number of passes does not grow with them. A row is
    unpivoted only if one of its values lies in an open range, which after the first pass few rows
    do.
    """
    if not columns:
        return {}
    kind = T.DoubleType()
    axis = {name: axis_value(name, kind) for name in columns}
    ends = []
    for number, value in enumerate(axis.values()):
        measures = {"n": F.count(value), "low": F.min(value), "high": F.max(value)}
        ends += [measure.alias(f"{text}{number}") for text, measure in measures.items()]
    row = df.agg(*ends).first()
    sizes = {name: row[f"n{number}"] for number, name in enumerate(columns)}
    search = Search(kind)
    for number, name in enumerate(columns):
        ranks = sorted(set(middle_ranks(sizes[name])))
        if ranks:
            low, high = (ordinal_of(row[f"{end}{number}"], kind) for end in ("low", "high"))
            search.add(Range((name,), low, high, 0, ranks))

    def step(now: Search) -> list:
        hits = [
            axis[part.group[0]].between(value_of(part.low, kind), value_of(part.high, kind))
            for part in now.open
        ]
        entries = [
            F.when(
                hit,
                F.struct(
                    F.lit(number).alias("_range"), axis[part.group[0]].alias("_axis")
                ),
            )
            for number, (part, hit) in enumerate(zip(now.open, hits, strict=True))
        ]
        touched = df.where(reduce(lambda a, b: a | b, hits))
        return histogram(touched.select(F.inline(F.array(*entries))), now)

    found = refined(search, step)
    return {
        name: middle(found[(name,)], sizes[name]) if sizes[name] else None for name in columns
    }


def large_medians(df: DataFrame, keys: Sequence[str], axis: Column, sizes: DataFrame) -> DataFrame:
    """Medians of the groups in ``sizes`` (keys and ``n``), as keys and ``_median``.

    The open ranges are a table of two ranks for each group. It is broadcast if it proves small,
    otherwise rows and ranges meet by a shuffle on the keys and the digits settled so far.

    Ordinals are written once: the passes filter by them, and a filter over the computation repeats
    it many times for a row.
    """
    keys = list(keys)
    known = df.select(*keys, axis.alias("_axis")).where("_axis IS NOT NULL")
    known = known.join(localised(sizes.select(*keys)), keys, "left_semi")
    rows = written(with_ordinal(known, T.DoubleType()), "ordinals")
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    both = F.explode(F.array_distinct(F.array(first, second)))
    state = settled(sizes.select(*keys, both.alias("_rank"), F.lit(0).cast("long").alias("_prefix")), "ranks")
    inside = rows
    for shift in range(64 - DIGIT, -1, -DIGIT):
        above = shift + DIGIT
        if above < 64:
            prefixed = rows.withColumn("_prefix", F.shiftright("_ordinal", above))
            ranges = state.select(*keys, "_prefix").distinct()
            inside = prefixed.join(localised(ranges), [*keys, "_prefix"]).drop("_prefix")
        counts = inside.groupBy(*keys, F.shiftright("_ordinal", shift).alias("_digit")).agg(
            F.count("*").alias("_n"), F.min("_axis").alias("_value")
        )
        prefix = F.shiftright("_digit", DIGIT) if above < 64 else F.lit(0).cast("long")
        counts = counts.withColumn("_prefix", prefix)
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_prefix").orderBy("_digit"))
        wanted = state.select(*keys, "_prefix", "_rank")
        placed = counts.withColumn("_below", upto - F.col("_n")).join(wanted, [*keys, "_prefix"])
        rank = F.col("_rank") - F.col("_below")
        holds = placed.where((rank >= 0) & (rank < F.col("_n")))
        state = settled(
            holds.select(*keys, rank.alias("_rank"), F.col("_digit").alias("_prefix"), "_value"),
            "ranks",
        )
    # One or two values; halves first, so that large ones don't overflow.
    mean = F.min("_value") / 2 + F.max("_value") / 2
    medians = settled(state.groupBy(*keys).agg(mean.alias("_median")), "medians")
    discard(rows)
    return medians


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    extra: Sequence[Column] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact median of ``value`` per group, with further aggregates ``extra``.

    A first count with map-side combine tells which groups exceed ``group_rows``. Those are searched
    digit by digit and never meet in one task; the multisets of the others fit into the buffers of
    one aggregation. Rows with a missing key are left out.
    """
    keys = list(keys)
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    axis = axis_value(value, T.DoubleType())
    sizes = known.groupBy(*keys).agg(F.count(axis).alias("n"))
    large = settled(sizes.where(F.col("n") > group_rows), "large-groups")
    if large.isEmpty():
        return known.groupBy(*keys).agg(F.median(axis).alias(name), *extra)
    marks = large_medians(known, keys, axis, large)
    settled_median = F.first("_median").alias(name)
    searched = known.join(marks, keys).groupBy(*keys).agg(settled_median, *extra)
    small = known.join(marks, keys, "left_anti").groupBy(*keys)
    return searched.unionByName(small.agg(F.median(axis).alias(name), *extra))
