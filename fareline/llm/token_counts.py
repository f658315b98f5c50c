"""Token counts as an exact histogram of encoded lengths.

Documents are encoded where they are read and reduced to how many have each length. Suffix sums
over the lengths then answer, for every context limit, how many documents are as long, how many
tokens they hold, what remains if all are cut to the limit, and where quantiles lie.

Defined results: a null or empty text has length 0; without documents the histogram is empty;
ids and other columns are not looked at, repeated rows count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareline.llm.bpe import encoder
from fareline.session import written

#: Lengths of so many consecutive values are summed in one window.
BLOCK = 1024


def histogram(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """``length`` and ``docs``: how many texts encode to so many tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        found: Counter[int] = Counter()
        for batch in batches:
            found.update(len(tool.encode(t or "")) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())],
            ["length", "docs"],
        )

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(
        count, "length long, docs long"
    )
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def with_sums(counts: DataFrame) -> DataFrame:
    """The histogram with suffix sums and what follows from them, for each length as a limit:

    ``docs_from`` and ``tokens_from``: documents of at least the length, and their tokens;
    ``truncated_tokens``: tokens that stay if every document is cut to the length;
    ``share_up_to``: share of the documents that are not longer.

    Sums run within blocks of lengths; the blocks' totals, one row for every 1,024 lengths, are
    summed by themselves, so no task holds all lengths.
    """
    # Sums read the histogram several times; encoding the texts once is enough.
    counts = written(counts, "histogram")
    rows = counts.select(
        "length",
        "docs",
        (F.col("length") * F.col("docs")).alias("tokens"),
        F.floor(F.col("length") / BLOCK).alias("block"),
    )
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy(F.desc("block"))
    later = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def plus(name: str, over) -> Column:
        return F.coalesce(F.sum(name).over(over), F.lit(0))

    blocks = blocks.select(
        "block",
        plus("d", later).alias("d_later"),
        plus("t", later).alias("t_later"),
        plus("d", whole).alias("d_all"),
        plus("t", whole).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    summed = rows.select(
        "*",
        F.sum("docs").over(inside).alias("d_here"),
        F.sum("tokens").over(inside).alias("t_here"),
    ).join(F.broadcast(blocks), "block")
    docs_from = F.col("d_here") + F.col("d_later")
    tokens_from = F.col("t_here") + F.col("t_later")
    return summed.select(
        "length",
        "docs",
        "tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("t_all") - tokens_from + F.col("length") * docs_from).alias("truncated_tokens"),
        ((F.col("d_all") - docs_from + F.col("docs")) / F.col("d_all")).alias("share_up_to"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each limit: documents and tokens in all, documents that are longer, and the tokens that
    stay if all are cut to it. Limits are a short list of the caller's."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    # A length counts for all limits at once: one aggregate for each, no pairs of rows.
    cells = []
    for k, limit in enumerate(limits):
        longer = F.col("length") > limit
        kept = F.when(longer, limit * F.col("docs")).otherwise(F.col("tokens"))
        cells += [
            F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias(f"longer{k}"),
            F.coalesce(F.sum(kept), F.lit(0)).alias(f"kept{k}"),
        ]
    total = sums.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        *cells,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(int(limit)).cast("long").alias("limit"),
                F.col(f"longer{k}").alias("longer"),
                F.col(f"kept{k}").alias("kept_tokens"),
            )
            for k, limit in enumerate(limits)
        ]
    )
    answers = total.select("docs", "tokens", F.inline(rows).alias("limit", "longer", "kept_tokens"))
    return asked.join(F.broadcast(answers), "limit")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share the smallest length that so many of the documents don't exceed."""
    cells = [
        F.min(F.when(F.col("share_up_to") >= share, F.col("length"))).alias(f"q{k}")
        for k, share in enumerate(shares)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(float(share)).alias("share"), F.col(f"q{k}").alias("length"))
            for k, share in enumerate(shares)
        ]
    )
    return sums.agg(*cells).select(F.inline(rows).alias("share", "length"))
