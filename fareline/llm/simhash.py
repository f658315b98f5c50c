"""SimHash near-duplicates by multi-index hashing.

Each text becomes a 64-bit fingerprint; fingerprints that differ in at most two bits are linked.
Distinct fingerprints are filed in tables by the two halves of 32 bits. Two linked fingerprints
differ in at most one bit of one of the halves. So the Hamming ball of radius one around each
distinct half is enumerated, the matching halves are fetched from the table, and the fingerprints
filed under a matching pair are compared in full. Of the two halves of a pair that differ, the one
with the 0 bit asks for the other, so each pair of halves is found once.

A half that many fingerprints share would compare them all with each other. Where a pair of halves
holds more than ``CROWD`` fingerprints, these are filed again under longer segments, the half and 16
bits of the rest, then 56 bits. Linked fingerprints of one half differ in at most one bit of one of
its longer segments as well: if they differ in one bit of the half, the rest holds one more at most,
so one part of it is equal; if the halves are equal, one part of the rest holds one of two bits at
most. A segment of 56 bits leaves 256 fingerprints, all of which are compared.

All joins are on distinct segments, each with a bounded number of partners, so no key is hot.
Documents find their component by the fingerprint; those that many documents share are few, and
are joined apart.

Defined results: null and empty texts, and texts without words, have the fingerprint zero and are
linked like any other; repeated rows share a fingerprint, so a component; null ids do not count as
the smallest id, and a component of null ids has a null one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.llm.arrays import text_blocks
from fareline.llm.components import components
from fareline.session import localised, written

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: A pair of segments with more fingerprints is searched by longer segments.
CROWD = 128
#: Fingerprints with more documents are joined apart.
CROWDED_DOCUMENTS = 10_000
#: Shingles whose bits are counted at once.
STEP = 1 << 14


def bits(first: int, count: int) -> list[int]:
    return list(range(first, first + count))


#: For each level the segments as lists of bits; segment k goes on in segments 2k and 2k + 1.
LEVELS = [[bits(32, 32), bits(0, 32)]]
for _size in (16, 8):
    _longer = []
    for _segment in LEVELS[-1]:
        _rest = [b for b in range(64) if b not in _segment]
        _longer += [_segment + _rest[:_size], _segment + _rest[_size:]]
    LEVELS.append(_longer)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def mask(segment: list[int]) -> int:
    return signed(sum(1 << b for b in segment))


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' hashes, as a signed value."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    count = max(len(words) - size + 1, 1)
    begin, end = starts[:count].tolist(), ends[-count:].tolist()
    votes = np.zeros(64, np.int64)
    for lo in range(0, count, STEP):
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(begin[lo : lo + STEP], end[lo : lo + STEP], strict=True)
        ]
        each = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(each, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE
) -> DataFrame:
    """``id`` and ``f``, the fingerprint of each text as a signed 64-bit value."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches):
            raw = data.tobytes()
            # bytes.lower() changes A-Z only, and bytes.split() cuts at 0x20 and 0x09 to 0x0D.
            texts = (raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            found = [fingerprint(text.lower().split(), size) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["id", "f"]
            )

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(find, f"id {texts.schema['id'].dataType.simpleString()}, f long")


def filed(rows: DataFrame, level: int) -> DataFrame:
    """``m``, ``f`` and ``v``: the fingerprint's bits in segment ``m`` of the level."""
    masks = F.array(*[F.lit(mask(segment)) for segment in LEVELS[level]])
    return rows.select("m", "f", F.col("f").bitwiseAND(F.get(masks, F.col("m"))).alias("v"))


def balls(values: DataFrame, level: int) -> DataFrame:
    """Each segment value ``v`` with the values ``w`` that it asks for: itself, if several
    fingerprints have it, and those with one of its 0 bits set."""
    flips = [F.array(*[F.lit(signed(1 << b)) for b in segment]) for segment in LEVELS[level]]
    zeros = F.filter(
        F.get(F.array(*flips), F.col("m")), lambda b: F.col("v").bitwiseAND(b) == F.lit(0)
    )
    itself = F.when(F.col("n") > 1, F.array(F.lit(0).cast("long")))
    asked = F.concat(F.coalesce(itself, F.array().cast("array<bigint>")), zeros)
    rows = values.select("m", "v", F.col("n").alias("nv"), F.explode(asked).alias("flip"))
    return rows.select("m", "v", "nv", F.col("v").bitwiseXOR(F.col("flip")).alias("w"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame) -> DataFrame:
    """``a`` and ``b``: pairs of the distinct fingerprints ``f`` with at most two differing bits.

    Pairs found under several segments are there several times, in either order.
    """
    found: list[DataFrame] = []
    rows = distinct.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("m"), "f")
    for level in range(len(LEVELS)):
        last = level + 1 == len(LEVELS)
        table = written(filed(rows, level), "segments")
        values = written(table.groupBy("m", "v").agg(F.count("*").alias("n")), "values")
        others = values.select("m", F.col("v").alias("w"), F.col("n").alias("nw"))
        pairs = written(balls(values, level).join(others, ["m", "w"]), "segment-pairs")
        size = F.col("nv") + F.col("nw")
        few = pairs if last else pairs.where(size <= CROWD)
        small = table
        if not last:
            full = values.where(F.col("n") > CROWD).select("m", "v")
            small = table.join(localised(full), ["m", "v"], "left_anti")
        left = small.select("m", "v", F.col("f").alias("a"))
        right = small.select("m", F.col("v").alias("w"), F.col("f").alias("b"))
        near = few.select("m", "v", "w").join(left, ["m", "v"]).join(right, ["m", "w"])
        once = (F.col("v") != F.col("w")) | (F.col("a") < F.col("b"))
        found.append(near.where(once & (differing("a", "b") <= DISTANCE)).select("a", "b"))
        crowded = pairs.where(size > CROWD)
        if last or crowded.isEmpty():
            break
        crowded = crowded.select("m", "v").unionByName(crowded.select("m", F.col("w").alias("v")))
        again = table.join(localised(crowded.distinct()), ["m", "v"], "left_semi")
        longer = F.array(2 * F.col("m"), 2 * F.col("m") + 1)
        rows = again.select(F.explode(longer).alias("m"), "f")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE
) -> DataFrame:
    """Per document: id, ``fingerprint`` in hexadecimal and ``component_id``, the smallest id that
    links reach."""
    prints = written(fingerprints(docs, id_column, text_column, size), "fingerprints")
    classes = prints.groupBy("f").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    label = components(links(classes.select("f"))).withColumnRenamed("node", "f")
    classes = classes.join(label, "f", "left").withColumn("l", F.coalesce("label", "f"))
    lows = classes.groupBy("l").agg(F.min("low").alias("component_id"))
    of_class = written(classes.join(lows, "l").select("f", "n", "component_id"), "components")
    # Fingerprints of many documents are few: at most one for each CROWDED_DOCUMENTS rows.
    shared = localised(of_class.where(F.col("n") > CROWDED_DOCUMENTS))
    rest = prints.join(shared.select("f"), "f", "left_anti")
    rest = rest.join(of_class.where(F.col("n") <= CROWDED_DOCUMENTS), "f")
    rows = prints.join(shared, "f").unionByName(rest)
    return rows.select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
