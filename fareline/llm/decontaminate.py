"""Benchmark decontamination with suffix arrays.

Every block of training texts gets a suffix array over its words; each test window is binary
searched in it, which gives all verbatim places of the window. Windows that follow each other in a
text as in an item are put together, which gives the longest verbatim match with each item and where
it stands in both. No training text is shuffled: the test items travel to the texts, in blocks of
bounded size.

A word is a run of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. A window
is ten consecutive words of an item; an item of fewer words, but at least one, is one window.

Defined results: a null or empty text has no words and is clean; a null or empty item has no
window; a null item id counts as the item named by the empty text; items that occur several times
count once; repeated documents give repeated results; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.llm.arrays import Hasher, alnum_table, in_batches, lean, text_blocks, text_bytes, word_spans
from fareline.session import written

WINDOW = 10
#: Test items are sent to the tasks in blocks of at most this many bytes of text.
QUERY_BYTES = 8_000_000


class TestWindows:
    """The distinct windows of a block of items, with the items that hold each."""

    def __init__(self, ids: list[str], texts: pa.Array, size: int):
        data, offsets = text_bytes(texts)
        starts, ends, rows = word_spans(data, offsets, alnum_table())
        hasher = Hasher()
        words = hasher.ranges(hasher.sums(data), starts, ends)
        self.vocabulary = np.unique(words)
        ranks = np.searchsorted(self.vocabulary, words) + 1
        spots: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k in range(len(ids)):
            own = ranks[rows[k] : rows[k + 1]].tolist()
            for at in range(max(1, len(own) - size + 1) if own else 0):
                spots[tuple(own[at : at + size])].append((k, at))
        self.size = size
        self.ids = ids
        self.windows = sorted(spots)
        self.items = [sorted({ids[k] for k, _ in spots[w]}) for w in self.windows]
        # Where each window stands: item and word within it.
        self.counts = np.array([len(spots[w]) for w in self.windows], dtype=np.int64)
        self.spots = np.array(
            [spot for w in self.windows for spot in spots[w]], dtype=np.int64
        ).reshape(-1, 2)
        # Fewest words of a window that begins with a vocabulary word; 0: none begins with it.
        self.need = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for window in self.windows:
            n = self.need[window[0]]
            self.need[window[0]] = min(n, len(window)) if n else len(window)
        self.slots = 1 << max(16, int(len(self.vocabulary) * 16).bit_length())
        self.maybe = np.zeros(self.slots, dtype=bool)
        self.maybe[self.slot(self.vocabulary)] = True
        self.patterns = [self.key(w) for w in self.windows]
        # Sorts behind every suffix that begins with the window.
        self.beyond = [p + b"\xff" * 4 for p in self.patterns]
        self.width = np.array([len(w) for w in self.windows], dtype=np.int64)

    def slot(self, words: np.ndarray) -> np.ndarray:
        return (words & np.uint64(self.slots - 1)).astype(np.int64)

    @staticmethod
    def key(ranks) -> bytes:
        return np.array(ranks, dtype=">u4").tobytes()

    def ranked(self, words: np.ndarray) -> np.ndarray:
        """Rank in the vocabulary from 1, 0 for other words."""
        out = np.zeros(len(words), dtype=np.int64)
        near = np.flatnonzero(self.maybe[self.slot(words)])
        at = np.searchsorted(self.vocabulary, words[near])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == words[near]
        out[near[same]] = at[same] + 1
        return out

    def matches(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (word index) and numbers of all windows that occur in the rows' words."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.windows or not len(words):
            return nothing
        ranks = self.ranked(words)
        # Words to the end of the run of vocabulary words, within the row.
        stop = np.zeros(len(ranks) + 1, dtype=bool)
        stop[:-1] = ranks == 0
        stop[rows] = True
        bounds = np.flatnonzero(stop)
        inside = np.flatnonzero(ranks)
        after = np.searchsorted(bounds, inside, side="right")
        run = np.minimum(bounds[after], len(ranks)) - inside
        need = self.need[ranks[inside]]
        keep = (need > 0) & (run >= need)
        places, run = inside[keep], run[keep]
        if not len(places):
            return nothing
        # The suffix array: places in the order of the words that follow them, to a window's size.
        padded = np.concatenate([ranks, np.zeros(self.size, np.int64)])
        table = np.zeros((len(places), self.size), dtype=">u4")
        for k in range(self.size):
            table[:, k] = np.where(run > k, padded[places + k], 0)
        suffixes = table.view(f"S{4 * self.size}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes, places = suffixes[order], places[order]
        low = np.searchsorted(suffixes, np.array(self.patterns, dtype=f"S{4 * self.size}"))
        cut = np.array([b[: 4 * self.size] for b in self.beyond], dtype=f"S{4 * self.size}")
        full = self.width == self.size
        high = np.where(
            full,
            np.searchsorted(suffixes, cut, side="right"),
            np.searchsorted(suffixes, cut, side="left"),
        )
        found = np.flatnonzero(high > low)
        counts = high[found] - low[found]
        at = np.repeat(low[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return places[at], np.repeat(found, counts)


    def longest_matches(
        self, places: np.ndarray, numbers: np.ndarray, row: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """The longest verbatim match of each row with each item: row, item, first word in the
        item and in the row, number of words; of equally long ones the first in the row, then in
        the item.

        Windows that follow each other both in the row and in the item are one match.
        """
        counts = self.counts[numbers]
        begin = np.cumsum(self.counts) - self.counts
        hit = np.repeat(np.arange(len(places)), counts)
        spot = begin[numbers][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts)
        item, at = self.spots[spot].T
        place, row, width = places[hit], row[hit], self.width[numbers][hit]
        order = np.lexsort((place, place - at, item, row))
        row, item, at, place, width = (c[order] for c in (row, item, at, place, width))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0)
        new[1:] |= (np.diff(place - at) != 0) | (np.diff(place) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order))[: len(first)] - 1
        size = place[last] - place[first] + width[last]
        row, item, at, place = (c[first] for c in (row, item, at, place))
        order = np.lexsort((at, place, -size, item, row))
        row, item, at, place, size = (c[order] for c in (row, item, at, place, size))
        best = np.ones(len(order), dtype=bool)
        best[1:] = (np.diff(row) != 0) | (np.diff(item) != 0)
        return row[best], item[best], at[best], place[best], size[best]


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[str], pa.Array]]:
    """The items, a bounded block at a time: at most ``limit`` bytes, or one item."""
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        text = row[1] or ""
        if ids and size + 4 * len(text) > limit:
            yield ids, pa.array(texts, pa.string())
            ids, texts, size = [], [], 0
        ids.append("" if row[0] is None else str(row[0]))
        texts.append(text)
        size += 4 * len(text)
    yield ids, pa.array(texts, pa.string())


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
MATCH = [("item", pa.string()), *[(n, pa.int64()) for n in ("item_first", "first", "words")]]
MATCHES = pa.list_(pa.struct(MATCH))


def search(texts: DataFrame, tests: TestWindows) -> DataFrame:
    """Per text: its words, the places that windows cover (first word, end), the items found, and
    the longest match with each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), alnum_table()
        for batch, data, offsets in text_blocks(batches):
            starts, ends, rows = word_spans(data, offsets, table)
            words = hasher.ranges(hasher.sums(data), starts, ends)
            places, numbers = tests.matches(words, rows)
            order = np.argsort(places, kind="stable")
            places, numbers = places[order], numbers[order]
            bounds = np.searchsorted(places, rows).tolist()
            hits: list[list] = []
            items: list[list] = []
            matches: list[list] = [[] for _ in range(len(batch))]
            of = np.searchsorted(rows, places, side="right") - 1
            for k, item, at, place, size in zip(
                *(c.tolist() for c in tests.longest_matches(places - rows[of], numbers, of)),
                strict=True,
            ):
                matches[k].append(
                    {"item": tests.ids[item], "item_first": at, "first": place, "words": size}
                )
            for row, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                first = places[lo:hi] - rows[row]
                found = np.unique(numbers[lo:hi]).tolist()
                items.append(sorted({i for n in found for i in tests.items[n]}))
                spans = covered(first, first + tests.width[numbers[lo:hi]])
                hits.append([{"first": a, "end": b} for a, b in spans])
            columns = [pa.array(np.diff(rows), pa.int64()), pa.array(hits, SPANS)]
            columns.append(pa.array(items, pa.list_(pa.string())))
            columns.append(pa.array(matches, MATCHES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *columns],
                ["row", "text_key", "n_words", "hits", "items", "matches"],
            )

    found = T.StructType.fromDDL(
        "text_key string, n_words long, hits array<struct<first:long,end:long>>, "
        "items array<string>, "
        "matches array<struct<item:string,item_first:long,first:long,words:long>>"
    )
    return in_batches(texts).mapInArrow(lean(scan), T.StructType([texts.schema["row"], *found.fields]))


def covered(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Ranges, sorted by their start, put together where they overlap or touch."""
    if not len(first):
        return []
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return list(zip(first[new].tolist(), reach[last].tolist(), strict=True))


def put_together(parts: list[DataFrame]) -> DataFrame:
    """Results of the same texts against several blocks of items; equal rows stay as many."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    grouped = rows.groupBy("row", "text_key", "n_words").agg(
        F.count("*").alias("n"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("all_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("matches"))).alias("matches"),
    )

    def step(out, span):
        last = F.element_at(out, -1)
        reach = F.greatest(last["end"], span["end"])
        grown = F.named_struct(F.lit("first"), last["first"], F.lit("end"), reach)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))
        apart = (F.size(out) == 0) | (span["first"] > F.try_element_at(out, F.lit(-1))["end"])
        return F.when(apart, F.concat(out, F.array(span))).otherwise(joined)

    nothing = F.array().cast("array<struct<first:bigint,end:bigint>>")
    copies = F.explode(F.array_repeat(F.lit(0), (F.col("n") / len(parts)).cast("int")))
    return grouped.select(
        "row", "n_words", F.aggregate("all_hits", nothing, step).alias("hits"), "items", "matches",
        copies,
    ).drop("col")


def found_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    columns: list[str],
    text_column: str = "text",
    item_column: str = "item_id",
    window: int = WINDOW,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Per document: ``row`` (struct of the named columns), n_words, hits, items (sorted names),
    n_hit, n_items, ``matches`` (the longest verbatim match with each item, of a window at least,
    with its first word in the item and in the document) and ``longest``, the words of the longest.

    Items of equal name are matched as items of their own.
    """
    tests = benchmark.select(F.col(item_column).cast("string"), F.col(text_column).cast("string"))
    texts = docs.select(
        F.struct(*columns).alias("row"), F.col(text_column).alias("text"), F.lit("").alias("text_key")
    )
    blocks = item_blocks(tests, query_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = search(texts, TestWindows(*first, window))
    else:
        # Each block is searched in all texts; the driver holds two blocks at a time, and only
        # the results are kept, in the shared folder.
        texts = texts.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
        found = put_together(
            [
                written(search(texts, TestWindows(*block, window)), "hits")
                for block in chain([first, second], blocks)
            ]
        )
    lengths = F.transform("hits", lambda x: x["end"] - x["first"])
    return found.select(
        "row",
        "n_words",
        "hits",
        "items",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("matches").alias("matches"),
        F.coalesce(F.array_max(F.col("matches.words")), F.lit(0).cast("long")).alias("longest"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    window: int = WINDOW,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``found_windows`` with the id in place of the row."""
    found = found_windows(
        docs, benchmark, [id_column], text_column, item_column, window, query_bytes
    )
    rest = [name for name in found.columns if name != "row"]
    return found.select(F.col("row")[id_column].alias(id_column), *rest)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in which no benchmark window occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = found_windows(docs, benchmark, docs.columns).where("n_hit = 0")
    return clean.select(*[F.col("row")[name].alias(name) for name in docs.columns])
