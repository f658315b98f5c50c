"""Periodic runs of words by recursive frequency splitting.

A run is a maximal stretch of words with smallest period q that holds at least two periods and at
least ``shortest`` words. Each of its words occurs in it at least twice. So a word that occurs once
within a segment is in no run of it and splits the segment; the pieces are split again by their own
counts until every word of every segment left occurs twice. Most prose ends here.

The surviving segments are scanned lag by lag. The words that equal the word one lag on form a
stretch of at least q places, so it covers one of the places at multiples of about q / 2 together
with the q / 2 words after it. Only those places are looked at, m log m of them for a segment of m
words, and a hash comparison decides. Hits are extended to both sides by binary search over prefix
hashes, and a stretch found for several lags keeps the smallest, as the others are its multiples.
Each run is verified word by word; a segment where a hash misled is scanned again without hashes.

Texts are worked on where they are read, many in one block of arrays; nothing is shuffled. A text is
worked on whole by one task, with about ten 64-bit values for each of its words.

Defined results: null and empty texts have no words and no runs, and an empty collapsed text;
repeated rows get equal results; null ids are kept; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.llm.arrays import BASE, Hasher, mix, space_table, text_blocks, word_spans

SHORTEST = 12
#: Places that one step of the lag scan looks at.
STEP_PLACES = 1_000_000
U64 = np.uint64
SPACES = r"[\x20\x09-\x0D]+"


def single(keys: np.ndarray) -> np.ndarray:
    """True for the entries whose value occurs once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    alone = np.ones(len(keys), dtype=bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    out = np.empty(len(keys), dtype=bool)
    out[order] = alone
    return out


def segments(words: np.ndarray, rows: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments in which every word occurs at least twice.

    ``rows`` holds the first word of each text, and the end of the last.
    """
    starts, ends = rows[:-1], rows[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = ends - starts >= shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        of = np.repeat(np.arange(len(starts)), sizes)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(of)) - first[of] + starts[of]
        rare = single(mix(words[place] + of.astype(U64) * U64(BASE)))
        split = np.zeros(len(starts), dtype=bool)
        split[of[rare]] = True
        done.append((starts[~split], ends[~split]))
        left = ~rare & split[of]
        place, of = place[left], of[left]
        if not len(place):
            break
        breaks = (np.diff(place) != 1) | (np.diff(of) != 0)
        starts = place[np.append(True, breaks)]
        ends = place[np.append(breaks, True)] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    order = np.argsort(found[0])
    return found[0][order], found[1][order]


class Prefixes:
    """Compares stretches of words by their polynomial hashes."""

    def __init__(self, words: np.ndarray):
        steps = np.full(len(words) + 1, BASE, U64)
        steps[0] = 1
        self.powers = np.cumprod(steps, dtype=U64)
        self.sums = np.zeros(len(words) + 1, U64)
        np.cumsum(mix(words) * self.powers[:-1], out=self.sums[1:])

    def equal(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        here = (self.sums[at + size] - self.sums[at]) * self.powers[lag]
        return here == self.sums[at + lag + size] - self.sums[at + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """How many words after (or before) ``at`` equal those one lag on, ``room`` at most."""
        low, high = np.zeros_like(room), room.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.equal(at - middle if back else at, lag, middle)
            low = np.where(fits, middle, low)
            high = np.where(fits, high, middle - 1)
        return low


def unique_runs(found: np.ndarray) -> np.ndarray:
    """Rows of (start, length, period), the smallest period for each start and length."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def lag_scan(
    words: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int
) -> np.ndarray:
    """Runs of the segments as rows of (start, length, period)."""
    hashes = Prefixes(words)
    sizes = ends - starts
    lags = sizes // 2
    of = np.repeat(np.arange(len(starts)), lags)
    lag = np.arange(len(of)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    step, width = (lag + 1) // 2, lag // 2 + 1
    count = np.maximum((sizes[of] - lag - width) // step + 1, 0)
    upto = np.cumsum(count)
    out = [np.zeros((0, 3), np.int64)]
    lo = 0
    while lo < len(of):
        before = upto[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(upto, before + STEP_PLACES, side="right")), lo + 1)
        own = np.repeat(np.arange(lo, hi), count[lo:hi])
        nth = np.arange(len(own)) - (upto[own] - count[own] - before)
        at, q = starts[of[own]] + nth * step[own], lag[own]
        lo = hi
        hit = words[at] == words[at + q]
        own, at, q = own[hit], at[hit], q[hit]
        hit = hashes.equal(at, q, width[own])
        own, at, q = own[hit], at[hit], q[hit]
        if not len(own):
            continue
        segment = of[own]
        after = hashes.reach(at, q, ends[segment] - at - q, back=False)
        before_it = hashes.reach(at, q, at - starts[segment], back=True)
        size = after + before_it + q
        long = size >= np.maximum(shortest, 2 * q)
        out.append(unique_runs(np.stack([at - before_it, size, q], axis=1)[long]))
    return unique_runs(np.concatenate(out))


def plain_scan(words: np.ndarray, start: int, end: int, shortest: int) -> np.ndarray:
    """Runs of one segment without hashes, in quadratic time."""
    out = [np.zeros((0, 3), np.int64)]
    for q in range(1, (end - start) // 2 + 1):
        same = words[start : end - q] == words[start + q : end]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        first, size = edges[::2], edges[1::2] - edges[::2] + q
        long = size >= max(shortest, 2 * q)
        rows = np.stack([start + first, size, np.full(len(first), q)], axis=1)
        out.append(rows[long])
    return unique_runs(np.concatenate(out))


def holds(words: np.ndarray, run: np.ndarray, start: int, end: int) -> bool:
    """Whether the run has its period, and neither neighbour in the segment extends it."""
    first, size, q = (int(x) for x in run)
    last = first + size
    if not np.array_equal(words[first : last - q], words[first + q : last]):
        return False
    longer = first > start and words[first - 1] == words[first - 1 + q]
    return not (longer or (last < end and words[last] == words[last - q]))


def runs_of(words: np.ndarray, rows: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Runs of texts given as word hashes, as rows of (first word, length, period), in order."""
    starts, ends = segments(words, rows, shortest)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    found = lag_scan(words, starts, ends, shortest)
    of = np.searchsorted(starts, found[:, 0], side="right") - 1
    wrong = {
        int(k)
        for run, k in zip(found, of, strict=True)
        if not holds(words, run, starts[k], ends[k])
    }
    for k in wrong:
        again = plain_scan(words, int(starts[k]), int(ends[k]), shortest)
        found = np.concatenate([found[of != k], again])
        of = np.searchsorted(starts, found[:, 0], side="right") - 1
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def covered(runs: np.ndarray, n: int) -> np.ndarray:
    """True for the words that a run repeats: all of it but its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shortest: int = SHORTEST,
) -> DataFrame:
    """Per document: id, ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``, the words that no run repeats, joined by one space."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for batch, data, offsets in text_blocks(batches):
            starts, ends, rows = word_spans(data, offsets, space_table())
            words = hasher.ranges(hasher.sums(data), starts, ends)
            runs = runs_of(words, rows, shortest)
            gone = covered(runs, len(words))
            cuts = np.searchsorted(runs[:, 0], rows)
            raw, texts = data.tobytes(), []
            for k in range(len(batch)):
                split = raw[offsets[k] : offsets[k + 1]].split()
                if cuts[k] < cuts[k + 1]:
                    kept = ~gone[rows[k] : rows[k + 1]]
                    split = [w for w, stays in zip(split, kept, strict=True) if stays]
                texts.append(b" ".join(split))
            own = np.repeat(rows[:-1], np.diff(cuts))
            columns = [runs[:, 0] - own, runs[:, 1], runs[:, 2]]
            values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(RUN))
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            collapsed = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), listed, collapsed], ["id", "runs", "collapsed"]
            )

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    run = "struct<start:bigint,length:bigint,period:bigint>"
    found = texts.mapInArrow(find, f"id {kind}, runs array<{run}>, collapsed string")
    return found.withColumnRenamed("id", id_column)


def with_periodic_tails(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id and text, where every tenth text, by the CRC of its id, repeats a stretch up to its end.

    Such a text of n words goes on from word a with words a to a + p - 1 over and over, where a and
    p come from the CRC. Its words are joined by one space. A null id changes nothing.
    """
    crc = F.crc32(F.col(id_column).cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        word = lambda i: F.get(w, source(i).cast("int"))
        tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
        return F.when(n > 0, tail).otherwise("")

    # The lambda's variable holds the words, so they are split once, not once for each word.
    split = F.filter(F.split(F.col(text_column), SPACES), lambda w: w != "")
    tail = F.get(F.transform(F.array(split), repeated), F.lit(0))
    text = F.when((crc % 10 == 0) & F.col(text_column).isNotNull(), tail)
    return docs.select(id_column, text.otherwise(F.col(text_column)).alias(text_column))
