"""Removal of repeated 100-byte strings by bucket-pointer refinement of suffixes.

The first buckets are those of 25-grams. A bucket's identifier is a fingerprint of what its
suffixes begin with, so a longer bucket follows from the identifiers at later offsets: 50 bytes
from two 25-gram identifiers, 100 bytes from two 50-byte ones, each level reusing the one before.

Not every suffix is sorted. Of the 25-grams within a 100-byte window, the one with the smallest
identifier (the first of equals) is the window's anchor; equal windows have equal anchors at equal
offsets. Windows with one anchor stand together, as a stretch. So

1. blocks of texts send each stretch to the bucket of its anchor, equal ones within a block once;
2. in a bucket, of equal stretches all but the earliest are repeats as a whole. A bucket whose
   stretches all agree is done; the earliest ones of the others stay open;
3. only open stretches are sent with their bytes, refined to 100 bytes, and compared by window;
4. a bucket with more stretches than a task should hold is not gathered at all: blocks refine its
   stretches to 100 bytes themselves and send each window to the part of its own identifier, equal
   windows of a block once.

A byte is removed if a repeated window covers it: one whose 100 bytes also start earlier, that is
in a smaller document id, or in the same document at an earlier place. Everything is judged on the
input. Identifiers have 64 bits (those of stretches are cut to 32 bits only to form buckets).

Defined results: ids are integers; a null id counts as the smallest; a null text is empty, and
texts of fewer than 100 bytes lose nothing; equal rows are one document and get equal results; rows
of one id with different texts are documents in the order of a hash of the text; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.llm.arrays import Hasher, in_batches, lean, mix, text_blocks
from fareline.session import written

LENGTH = 100
GRAM = 25
U64 = np.uint64
#: Places within a piece must fit these bits; longer texts are cut into pieces that overlap.
PLACE_BITS = 24
PIECE_BYTES = 8_000_000
#: Text bytes whose stretches meet in one task, and open windows that do.
GROUP_BYTES = 16_000_000
GROUP_STRETCHES = 20_000
#: A bucket of so many stretches is split by its windows, and windows that meet in one task.
HOT_STRETCHES = 20_000
GROUP_WINDOWS = 1_000_000
#: Texts of a task are searched in blocks of about this many bytes.
BLOCK_BYTES = 1_000_000
#: A task packs so many stretches, of several blocks, into one row for each part.
PACKED_STRETCHES = 500_000
#: Lists of documents up to this length are broadcast to pick their texts before a shuffle.
BROADCAST_ROWS = 2_000_000
NO_ID = -(1 << 63)


def gram_ids(sums: np.ndarray, hasher: Hasher, size: int) -> np.ndarray:
    """Bucket identifiers of the ``size``-grams that start at each byte."""
    count = len(sums) - size
    if count <= 0:
        return np.zeros(0, U64)
    return mix((sums[size:] - sums[:count]) * hasher.inverses[:count])


def window_anchors(ids: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``length`` bytes, the place of its smallest bucket, the first of equals."""
    span = length - gram + 1
    if len(ids) < span:
        return np.zeros(0, np.int64)
    place = U64((1 << PLACE_BITS) - 1)
    low = (ids & ~place) | np.arange(len(ids), dtype=U64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & place).astype(np.int64)


def stretches(ids: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: row, first and last start, anchor."""
    anchors = window_anchors(ids, length, gram)
    starts = np.arange(len(anchors))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchors)]
    inside = starts + length <= offsets[1:][row]
    starts, row, anchors = starts[inside], row[inside], anchors[inside]
    if not len(starts):
        return row, starts, starts, anchors
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], starts[first], starts[last], anchors[first]


def refined(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 100-byte buckets at some places, from those of 25-grams: a level's
    identifier is made of the identifiers of the level below, here and half its length on."""
    half = mix(grams[at] + mix(grams[at + GRAM] + U64(1)))
    later = mix(grams[at + 2 * GRAM] + mix(grams[at + 3 * GRAM] + U64(1)))
    return mix(half + mix(later + U64(2)))


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes and offsets to work on at once, and the place of the first byte. Only a text that is
    longer than a piece is cut; windows that cross a cut belong to the piece they start in."""
    if len(data) <= PIECE_BYTES:
        yield data, offsets, 0
        return
    for at in range(0, len(data), PIECE_BYTES):
        part = data[at : at + PIECE_BYTES + LENGTH - 1]
        yield part, np.array([0, len(part)]), at


def packed(parts: np.ndarray, groups: int, columns: list[np.ndarray], shared: list[bytes]):
    """One row for each part: its number, the shared values and the part's share of the columns."""
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(groups + 1))
    for k in range(groups):
        own = order[cuts[k] : cuts[k + 1]]
        if len(own):
            yield [k, *shared, *[c[own].tobytes() for c in columns]]


def batch_of(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * (len(names) - 1)]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def unpacked(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


STRETCH_NAMES = ["part", "ids", "keys", "doc", "bucket", "stretch", "low", "size", "lead"]


class Packer:
    """Stretches of several blocks, packed into one row for each part.

    A row names the documents that it holds stretches of, so its size goes with its stretches,
    however many parts there are.
    """

    def __init__(self, groups: int):
        self.groups, self.size, self.docs = groups, 0, 0
        self.blocks: list[tuple[np.ndarray, ...]] = []

    def add(self, parts, ids, keys, row, columns) -> None:
        """A block: its documents' ids and keys, and part, document and values of each stretch."""
        self.blocks.append((parts, ids, keys, row + self.docs, *columns))
        self.size += len(parts)
        self.docs += len(ids)

    def rows(self) -> Iterator[list]:
        parts, ids, keys, row, *columns = (
            np.concatenate(c) for c in zip(*self.blocks, strict=True)
        )
        order = np.argsort(parts, kind="stable")
        cuts = np.searchsorted(parts[order], np.arange(self.groups + 1))
        for k in range(self.groups):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own):
                docs, number = np.unique(row[own], return_inverse=True)
                number = number.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32)
                shared = [ids[docs].tobytes(), keys[docs].tobytes(), number.tobytes()]
                yield [k, *shared, *[c[own].tobytes() for c in columns]]
        self.__init__(self.groups)


def stretch_rows(texts: DataFrame, groups: int) -> DataFrame:
    """The stretches of all texts, packed by part; within a block equal ones once, the later of
    them already as repeats, in the part ``groups``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        packer = Packer(groups + 1)
        for batch, data, offsets in text_blocks(batches, 2, BLOCK_BYTES):
            ids = np.array(batch.column(0).to_numpy(), dtype=np.int64)
            keys = np.array(batch.column(1).to_numpy(), dtype=np.int64)
            for part, bounds, base in pieces(data, offsets):
                sums = hasher.sums(part)
                grams = gram_ids(sums, hasher, GRAM)
                row, low, high, anchor = stretches(grams, bounds, LENGTH, GRAM)
                if not len(row):
                    continue
                bucket = grams[anchor]
                whole = hasher.ranges(sums, low, high + LENGTH)
                whole = mix(whole + (anchor - low).astype(U64))
                start = low - bounds[row] + base
                size, lead = (high - low + 1).astype(np.uint8), (anchor - low).astype(np.uint8)
                order = np.lexsort((start, keys[row], ids[row]))
                _, first, kind = np.unique(
                    whole[order] ^ mix(bucket[order]), return_index=True, return_inverse=True
                )
                mine = np.empty(len(row), dtype=np.int64)
                mine[order] = order[first][kind]
                owner, text = ids[row], keys[row]
                later = (owner != owner[mine]) | (text != text[mine]) | (start != start[mine])
                # Equal rows (same id and text) are one document: their copies go nowhere.
                parts = np.where(later, groups, groups + 1)
                parts[mine] = ((bucket[mine] >> U64(32)) % U64(groups)).astype(np.int64)
                columns = [
                    (bucket & U64(0xFFFFFFFF)).astype(np.uint32), whole, start.astype(np.uint32),
                    size, lead,
                ]
                stay = parts <= groups
                columns = [c[stay] for c in columns]
                packer.add(parts[stay].astype(np.int32), ids, keys, row[stay], columns)
                if packer.size >= PACKED_STRETCHES:
                    yield batch_of(list(packer.rows()), STRETCH_NAMES)
        if packer.size:
            yield batch_of(list(packer.rows()), STRETCH_NAMES)

    return in_batches(texts).mapInArrow(lean(scan), "part long, " + ", ".join(f"{n} binary" for n in STRETCH_NAMES[1:]))


#: Ranges of window starts, with the anchor if the windows are still open, else -1.
RANGES = "id long, key long, low long, high long, anchor long"


def ranges_table(ids, keys, low, high, anchor) -> pa.Table:
    names = ["id", "key", "low", "high", "anchor"]
    columns = [np.asarray(c, dtype=np.int64) for c in (ids, keys, low, high, anchor)]
    return pa.table(dict(zip(names, columns, strict=True)))


def bucket_search(table: pa.Table) -> pa.Table:
    """Repeated and open stretches of the buckets of a part."""
    ids = unpacked(table, "ids", np.int64)
    keys = unpacked(table, "keys", np.int64)
    bucket = unpacked(table, "bucket", np.uint32)
    docs = [
        doc_numbers(x, len(b))
        for x, b in zip(table.column("doc").to_pylist(), bucket, strict=True)
    ]
    owner = np.concatenate([i[d] for i, d in zip(ids, docs, strict=True)])
    text = np.concatenate([k[d] for k, d in zip(keys, docs, strict=True)])
    bucket = np.concatenate(bucket)
    whole = np.concatenate(unpacked(table, "stretch", np.uint64))
    low = np.concatenate(unpacked(table, "low", np.uint32)).astype(np.int64)
    size = np.concatenate(unpacked(table, "size", np.uint8)).astype(np.int64)
    lead = np.concatenate(unpacked(table, "lead", np.uint8)).astype(np.int64)
    order = np.lexsort((low, text, owner, whole, bucket))
    owner, text, bucket, whole, low, size, lead = (
        c[order] for c in (owner, text, bucket, whole, low, size, lead)
    )
    new = np.ones(len(order), dtype=bool)
    new[1:] = (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1])
    firsts = np.flatnonzero(new)
    mine = firsts[np.cumsum(new) - 1]
    later = (owner != owner[mine]) | (text != text[mine]) | (low != low[mine])
    # Buckets with more than one kind of stretch: their earliest ones are open.
    kinds = bucket[firsts]
    several = np.zeros(len(kinds), dtype=bool)
    several[1:] |= kinds[1:] == kinds[:-1]
    several[:-1] |= kinds[1:] == kinds[:-1]
    opened = firsts[several]
    at = np.concatenate([np.flatnonzero(later), opened])
    anchor = np.full(len(at), -1)
    if len(opened):
        anchor[-len(opened) :] = low[opened] + lead[opened]
    return ranges_table(owner[at], text[at], low[at], low[at] + size[at] - 1, anchor)


def doc_numbers(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * count else np.uint32)


def hot_buckets(rows: DataFrame) -> dict[int, np.ndarray]:
    """By part, the buckets to be split. A task names those it holds often enough that a bucket
    of 2 * ``HOT_STRETCHES`` stretches can't escape, however they are dealt; at most one bucket
    for every ``HOT_STRETCHES`` stretches is listed."""
    least = max(1, HOT_STRETCHES // max(1, rows.rdd.getNumPartitions()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            parts = batch.column(0).to_numpy().astype(U64)
            found = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)]
            sizes = [len(f) for f in found]
            own = (np.repeat(parts, sizes) << U64(32)) | np.concatenate(found).astype(U64)
            own, n = np.unique(own, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
        often = counts >= least
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[often].astype(np.int64)), pa.array(counts[often], pa.int64())],
            ["bucket", "n"],
        )

    named = rows.select("part", "bucket").mapInArrow(count, "bucket long, n long")
    listed = named.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_STRETCHES)
    keys = np.array(listed.select("bucket").toArrow()["bucket"]).astype(np.int64)
    parts = keys >> 32
    return {int(k): np.sort(keys[parts == k] & 0xFFFFFFFF) for k in np.unique(parts)}


def without_hot(rows: DataFrame, hot: dict[int, np.ndarray]) -> DataFrame:
    """The packed stretches of all other buckets."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bucket = np.frombuffer(row["bucket"], np.uint32)
                if row["part"] in hot:
                    stay = ~np.isin(bucket, hot[row["part"]])
                    for name in STRETCH_NAMES[3:]:
                        raw = np.frombuffer(row[name], np.uint8).reshape(len(bucket), -1)
                        row[name] = raw[stay].tobytes()
                    bucket = bucket[stay]
                if len(bucket):
                    yield batch_of([[row[name] for name in STRETCH_NAMES]], STRETCH_NAMES)

    return rows.mapInArrow(strip, rows.schema)


def hot_ranges(rows: DataFrame, hot: dict[int, np.ndarray]) -> DataFrame:
    """The stretches of the buckets to be split, as open ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bucket = np.frombuffer(row["bucket"], np.uint32)
                own = np.isin(bucket, hot[row["part"]])
                doc = doc_numbers(row["doc"], len(bucket))[own]
                low = np.frombuffer(row["low"], np.uint32)[own].astype(np.int64)
                size, lead = (np.frombuffer(row[n], np.uint8)[own] for n in ("size", "lead"))
                ids, keys = (np.frombuffer(row[n], np.int64)[doc] for n in ("ids", "keys"))
                found = ranges_table(ids, keys, low, low + size - 1, low + lead)
                yield from found.to_batches()

    return rows.where(F.col("part").isin(list(hot))).mapInArrow(read, RANGES)


def block_repeats(rows: DataFrame) -> DataFrame:
    """The ranges that blocks found to be repeats by themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(k, 1)])
                ids, keys = unpacked(one, "ids", np.int64)[0], unpacked(one, "keys", np.int64)[0]
                low = unpacked(one, "low", np.uint32)[0].astype(np.int64)
                size = unpacked(one, "size", np.uint8)[0].astype(np.int64)
                doc = doc_numbers(one.column("doc")[0].as_py(), len(low))
                found = ranges_table(
                    ids[doc], keys[doc], low, low + size - 1, np.full(len(low), -1)
                )
                yield from found.to_batches()

    return rows.mapInArrow(read, RANGES)


OPEN_NAMES = ["part", "ids", "keys", "low", "size", "bytes"]


def open_rows(texts: DataFrame, groups: int) -> DataFrame:
    """The open stretches with their bytes, packed by part of their bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for batch, data, offsets in text_blocks(batches, 2, BLOCK_BYTES):
            ids = np.array(batch.column(0).to_numpy(), dtype=np.int64)
            keys = np.array(batch.column(1).to_numpy(), dtype=np.int64)
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            low, high, anchor = (
                values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high", "anchor")
            )
            row = np.repeat(np.arange(batch.num_rows), counts)
            shift = offsets[:-1][row]
            grams = [data[a : a + GRAM] for a in (anchor + shift).tolist()]
            joined = np.concatenate([*grams, np.zeros(0, np.uint8)])
            bucket = gram_ids(hasher.sums(joined), hasher, GRAM)[:: GRAM][: len(row)]
            spans = [
                data[a:b] for a, b in zip((low + shift).tolist(), (high + shift + LENGTH).tolist())
            ]
            parts = ((bucket >> U64(32)) % U64(groups)).astype(np.int64)
            order = np.argsort(parts, kind="stable")
            cuts = np.searchsorted(parts[order], np.arange(groups + 1))
            rows = []
            for k in range(groups):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    raw = np.concatenate([spans[i] for i in own.tolist()]).tobytes()
                    rows.append(
                        [
                            k, ids[row[own]].tobytes(), keys[row[own]].tobytes(),
                            low[own].astype(np.int64).tobytes(),
                            (high - low + 1)[own].astype(np.uint8).tobytes(), raw,
                        ]
                    )
            if rows:
                yield batch_of(rows, OPEN_NAMES)

    return texts.mapInArrow(scan, "part long, " + ", ".join(f"{n} binary" for n in OPEN_NAMES[1:]))


def window_search(table: pa.Table) -> pa.Table:
    """Repeated windows among the open stretches of a part."""
    hasher = Hasher(lower=False)
    ids, keys, low = (
        np.concatenate(unpacked(table, n, np.int64)) for n in ("ids", "keys", "low")
    )
    size = np.concatenate(unpacked(table, "size", np.uint8)).astype(np.int64)
    raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    ends = np.cumsum(size + LENGTH - 1)
    begins = ends - size - LENGTH + 1
    # The order of documents and places; windows follow it, so the first of equals is the earliest.
    order = np.lexsort((low, keys, ids))
    ids, keys, low, size, begins = (c[order] for c in (ids, keys, low, size, begins))
    grams = np.concatenate([gram_ids(hasher.sums(raw), hasher, GRAM), np.zeros(1, U64)])
    total = int(size.sum())
    stretch = np.repeat(np.arange(len(size)), size)
    step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    values = refined(grams, begins[stretch] + step)
    by = np.argsort(values, kind="stable")
    new = np.ones(total, dtype=bool)
    new[1:] = values[by][1:] != values[by][:-1]
    first = np.empty(total, dtype=np.int64)
    first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    a, b = stretch, stretch[first]
    same = (ids[a] == ids[b]) & (keys[a] == keys[b]) & (low[a] + step == low[b] + step[first])
    repeat = np.flatnonzero(~same)
    edge = np.ones(len(repeat), dtype=bool)
    edge[1:] = (repeat[1:] != repeat[:-1] + 1) | (stretch[repeat][1:] != stretch[repeat][:-1])
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(repeat)) - 1
    s, e = repeat[start], repeat[stop] if len(repeat) else repeat
    return ranges_table(
        ids[stretch[s]],
        keys[stretch[s]],
        low[stretch[s]] + step[s],
        low[stretch[s]] + step[e],
        np.full(len(s), -1),
    )


WINDOW_NAMES = ["part", "windows", "ids", "keys", "places"]


def earlier_windows(values, ids, keys, places) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal windows, and those that are repeats of an earlier one."""
    order = np.lexsort((places, keys, ids, values))
    v = values[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    mine = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = (ids[order] == ids[mine]) & (keys[order] == keys[mine])
    same &= places[order] == places[mine]
    return order[new], order[~same]


def repeated_windows(ids, keys, places) -> pa.Table:
    """Ranges of the starts of repeated windows."""
    order = np.lexsort((places, keys, ids))
    ids, keys, places = ids[order], keys[order], places[order]
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (places[1:] > places[:-1] + 1)
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(order))[: len(start)] - 1
    return ranges_table(ids[start], keys[start], places[start], places[stop], np.full(len(start), -1))


def window_rows(texts: DataFrame, groups: int) -> DataFrame:
    """The windows of open ranges, packed by part of their own identifiers; of equal windows of a
    block only the earliest, the repeats in the part ``groups``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for batch, data, offsets in text_blocks(batches, 2, BLOCK_BYTES):
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            low, high = (values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            spans = zip(
                (low + offsets[:-1][row]).tolist(),
                (high + offsets[:-1][row] + LENGTH).tolist(),
                strict=True,
            )
            raw = np.concatenate([*[data[a:b] for a, b in spans], np.zeros(0, np.uint8)])
            size = high - low + 1
            stretch = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(stretch)) - np.repeat(np.cumsum(size) - size, size)
            begins = np.cumsum(size + LENGTH - 1) - size - LENGTH + 1
            grams = gram_ids(hasher.sums(raw), hasher, GRAM)
            found = refined(grams, begins[stretch] + step)
            places = low[stretch] + step
            ids, keys = (
                np.array(batch.column(k).to_numpy(), np.int64)[row[stretch]] for k in (0, 1)
            )
            first, later = earlier_windows(found, ids, keys, places)
            parts = np.full(len(found), groups + 1)
            parts[later] = groups
            parts[first] = ((found[first] >> U64(32)) % U64(groups)).astype(np.int64)
            rows = list(packed(parts, groups + 1, [found, ids, keys, places], []))
            if rows:
                yield batch_of(rows, WINDOW_NAMES)

    return texts.mapInArrow(scan, "part long, " + ", ".join(f"{n} binary" for n in WINDOW_NAMES[1:]))


def window_part(table: pa.Table) -> pa.Table:
    """Repeated windows among those of a part."""
    found = np.concatenate(unpacked(table, "windows", U64))
    ids, keys, places = (
        np.concatenate(unpacked(table, n, np.int64)) for n in ("ids", "keys", "places")
    )
    _, later = earlier_windows(found, ids, keys, places)
    return repeated_windows(ids[later], keys[later], places[later])


def window_repeats(rows: DataFrame) -> DataFrame:
    """The windows that blocks found to be repeats by themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = (np.frombuffer(row[n], np.int64) for n in ("ids", "keys", "places"))
                yield from repeated_windows(*own).to_batches()

    return rows.mapInArrow(read, RANGES)


def hot_repeats(texts: DataFrame, opened: DataFrame) -> DataFrame:
    """Repeated windows of the buckets that are split."""
    opened = written(opened, "hot")
    total = opened.agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0] or 0
    groups = max(4, -(-total // GROUP_WINDOWS))
    by_text, listed = of_texts(texts, opened)
    chosen = texts.join(listed, ["id", "key"], "left_semi").join(by_text, ["id", "key"])
    rows = window_rows(chosen.select("id", "key", "text", "ranges"), groups)
    rows = written(rows, "windows")
    inside = window_repeats(rows.where(F.col("part") == groups))
    across = rows.where(F.col("part") < groups).groupBy("part").applyInArrow(window_part, RANGES)
    return inside.unionByName(across)


def of_texts(texts: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ranges`` gathered by document, and the ids of these documents, broadcast if few."""
    by_text = ranges.groupBy("id", "key").agg(
        F.collect_list(F.struct("low", "high", "anchor")).alias("ranges")
    )
    by_text = written(by_text, "ranges")
    listed = by_text.select("id", "key")
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return by_text, listed


def repeats(texts: DataFrame, size_bytes: int) -> DataFrame:
    """Ranges of starts of all repeated windows, of texts as ``id``, ``key`` and ``text``."""
    groups = max(4, -(-size_bytes // GROUP_BYTES))
    rows = written(stretch_rows(texts, groups), "stretches")
    inside = block_repeats(rows.where(F.col("part") == groups))
    packed_rows = rows.where(F.col("part") < groups)
    hot = hot_buckets(packed_rows)
    if hot:
        split = hot_repeats(texts, hot_ranges(packed_rows, hot))
        inside = inside.unionByName(split)
        packed_rows = without_hot(packed_rows, hot)
    found = packed_rows.groupBy("part").applyInArrow(bucket_search, RANGES)
    found = written(found, "buckets")
    opened = found.where("anchor >= 0")
    groups = max(4, -(-opened.count() // GROUP_STRETCHES))
    by_text, listed = of_texts(texts, opened)
    chosen = texts.join(listed, ["id", "key"], "left_semi").join(by_text, ["id", "key"])
    sent = open_rows(chosen.select("id", "key", "text", "ranges"), groups)
    windows = sent.groupBy("part").applyInArrow(window_search, RANGES)
    return inside.unionByName(found.where("anchor < 0")).unionByName(windows)


def removed(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, runs of them, and the bytes that stay."""
    change = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, data[~gone].tobytes()


def dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes."""
    source = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    texts = source.select(
        "doc",
        F.coalesce(F.col("doc").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("key"),
        "text",
    )
    size_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = source.schema["doc"]
    plain = texts.select("id", "key", "text")
    by_text, listed = of_texts(plain, repeats(plain, size_bytes))
    fields = [
        T.StructField("doc", kind.dataType),
        *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept", T.BinaryType())] if with_text else []),
    ]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, 1, BLOCK_BYTES):
            lists = batch.column(2) if batch.num_columns > 2 else None
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                gone, runs, kept = 0, 0, None
                if lists is not None and lists[k].is_valid:
                    values = lists[k].values
                    low, high = (values.field(n).to_numpy() for n in ("low", "high"))
                    gone, runs, kept = removed(text, low, high)
                kept = text.tobytes() if kept is None else kept
                digest = hashlib.sha256(kept).hexdigest()
                for column, value in zip(out, (len(text), gone, runs, digest, kept), strict=True):
                    column.append(value)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]]]
            columns.append(pa.array(out[3], pa.string()))
            if with_text:
                columns.append(pa.array(out[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    # Texts without repeats need no shuffle.
    clean = texts.join(listed, ["id", "key"], "left_anti").select("doc", "text")
    touched = texts.join(listed, ["id", "key"], "left_semi").join(by_text, ["id", "key"])
    result = clean.mapInArrow(finish, T.StructType(fields)).unionByName(
        touched.select("doc", "text", "ranges").mapInArrow(finish, T.StructType(fields))
    )
    return result.withColumnRenamed("doc", id_column)
