"""Text columns as byte arrays inside tasks: words and their hashes without a Python string each."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Texts of one task are worked on in blocks of about this many bytes; a longer text goes alone.
BLOCK_BYTES = 500_000

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: Bytes that a task sends to Python at a time.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_batches(texts: DataFrame) -> DataFrame:
    """The texts, on their way to Python in batches of ``BATCH_BYTES``.

    Spark's own 64 MB are held several times over, outside of the heap. The session's setting is
    changed, unless the session names a size itself.
    """
    spark = texts.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return texts


def give_back() -> None:
    """Return freed memory to the system. Spark keeps a Python worker for later tasks, and its
    allocators keep what the largest batch took, beside the memory that the executor itself has."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable) -> Callable:
    """A function over a task's batches that gives memory back when the task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def lean_group(function: Callable) -> Callable:
    """A function of a group's table (and of its key, if it takes two) that gives memory back."""
    if function.__code__.co_argcount == 2:

        def run(key: tuple, table: pa.Table) -> pa.Table:
            try:
                return function(key, table)
            finally:
                give_back()

        return run

    def run_one(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            give_back()

    return run_one


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> U64(30))
    values = values * U64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> U64(27))
    values = values * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; a null row has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their text column and the rows' offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for lo, hi in blocks(offsets, limit):
            yield (
                batch.slice(lo, hi - lo),
                data[offsets[lo] : offsets[hi]],
                offsets[lo : hi + 1] - offsets[lo],
            )


def lower_table() -> np.ndarray:
    """Byte values with A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for the bytes of words that end at a blank or one of 0x09 to 0x0D."""
    table = np.ones(256, dtype=bool)
    table[[0x20, 9, 10, 11, 12, 13]] = False
    return table


def alnum_table() -> np.ndarray:
    """True for digits, a-z, A-Z and all bytes of characters beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def word_spans(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and, for each row, the index of its first word (one more entry).

    A word is a maximal run of bytes that ``table`` holds, within its row.
    """
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside[:-1].copy()
    last &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts <= len(data))]
    last[inner - 1] = inside[inner - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """64-bit hashes of byte ranges from running polynomial sums."""

    def __init__(self, lower: bool = True, seed: int = 1):
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.values = values[lower_table()] if lower else values
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the ranges; equal text of equal length has equal hashes at any place."""
        raw = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes, one for each start (rows aren't heeded)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for k in range(size):
        total = mix(total + words[k : k + count] + U64(k + 1))
    return total
