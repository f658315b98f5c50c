"""Similarity join on word n-grams by vertical partitioning.

The n-grams have a global order, rare ones first, which is cut into fragments. A pair's overlap is
counted fragment by fragment, and the partial counts are summed per pair. Three steps keep the
pairs few without losing a link:

1. Texts with equal sets are one class; all further work is on classes.
2. A class can only be linked if nearly all its n-grams occur in other classes as well. Passes
   over parts of the n-gram space count, for each class, the n-grams that no other class has, and
   drop the class as soon as they are too many. This drops most texts of a corpus.
3. Classes that share an n-gram among the first few of their order (the prefix that any linked pair
   must share) are candidates. Each bucket compares its members with one centre first. Only
   buckets whose members are not in one component by then compare members of different
   components and of neighbouring bands of size, and a bound from lengths and positions, which
   every linked pair keeps, cuts those. A large bucket is dealt out by salts.

Links within a component that is already connected are not counted, as they change nothing:
the result is components. Sets and n-grams are 64-bit hashes; with n classes a false merge
has a probability of about n squared / 2^65.

Defined results: null and empty texts, and texts without words, have an empty set and are linked
with nothing; repeated rows are linked with each other; a text of fewer words than an n-gram has
its whole sequence as the one element; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.llm.arrays import (
    Hasher,
    in_batches,
    lean,
    lean_group,
    mix,
    space_table,
    text_blocks,
    windows,
    word_spans,
)
from fareline.llm.components import components
from fareline.session import written

SHINGLE = 4
PERCENT = 85
#: What the pipeline's stage for near copies takes.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
#: The n-gram space is searched for unique n-grams in so many passes.
PASSES = 4
#: About as many n-grams are held by a task that looks for unique ones.
GROUP_GRAMS = 800_000
#: A task packs so many n-grams, of several blocks, into one row for each part.
PACKED_GRAMS = 1_500_000
#: A list of document ids is broadcast up to so many rows, beyond that the texts are shuffled.
BROADCAST_ROWS = 2_000_000
#: Buckets of more classes are dealt out by salts when their members are compared.
BUCKET_ROWS = 1_000
U64 = np.uint64


def sets_of(
    data: np.ndarray, offsets: np.ndarray, hasher: Hasher, size: int
) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams."""
    starts, ends, rows = word_spans(data, offsets, space_table())
    words = hasher.ranges(hasher.sums(data), starts, ends)
    grams = windows(words, size)
    bounds = rows.tolist()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if hi - lo >= size:
            yield np.unique(grams[lo : hi - size + 1])
        elif hi > lo:
            yield windows(words[lo:hi], hi - lo)
        else:
            yield grams[:0]


def class_id(grams: np.ndarray) -> int:
    """Fingerprint of a set, as a signed 64-bit number."""
    total = mix(grams ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) + U64(len(grams))
    return int(mix(np.array([total]))[0].astype(np.int64))


def document_sets(docs: DataFrame, columns: list[str], text_column: str, size: int) -> DataFrame:
    """``row`` (struct of the named columns), ``n`` (size of the set) and ``c`` (its class)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch, data, offsets in text_blocks(batches):
            n, c = [], []
            for grams in sets_of(data, offsets, hasher, size):
                n.append(len(grams))
                c.append(class_id(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                ["row", "n", "c"],
            )

    texts = docs.select(F.struct(*columns).alias("row"), F.col(text_column).alias("text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("c", T.LongType())]
    return in_batches(texts).mapInArrow(lean(scan), T.StructType([texts.schema["row"], *fields]))


class Owned:
    """N-grams of several blocks with their owners, packed into one row for each part.

    An n-gram takes 13 bytes in whatever number of parts: 32 bits of its own hash, 40 bits of its
    class and the owner's number, which tells where its count belongs.
    """

    def __init__(self, groups: int):
        self.groups, self.size, self.owners = groups, 0, 0
        self.blocks: list[tuple[np.ndarray, ...]] = []

    def add(self, grams: np.ndarray, owner: np.ndarray, classes: np.ndarray) -> None:
        """Distinct n-grams of a block; the owner is -1 where the block itself has several."""
        own = np.where(owner < 0, -1, owner + self.owners).astype(np.int32)
        kind = np.where(owner < 0, U64(0), classes.view(U64)[owner] >> U64(24))
        group = (((grams >> U64(32)) & U64(0xFFFFFF)) % U64(self.groups)).astype(np.int32)
        tag = (kind >> U64(8)).astype(np.uint32), (kind & U64(0xFF)).astype(np.uint8)
        self.blocks.append((group, own, grams.astype(np.uint32), *tag, classes))
        self.size += len(grams)
        self.owners += len(classes)

    def rows(self, name: int) -> pa.RecordBatch:
        group, own, *columns, classes = (np.concatenate(c) for c in zip(*self.blocks, strict=True))
        # In the order of owners, so that a part's neighbouring n-grams have much in common.
        order = np.lexsort((own, group))
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        # The owners' classes take the way of a part as well, to where counts are summed.
        rows: list[list] = [[-1 - name % self.groups, name, classes.tobytes(), b"", b"", b""]]
        for k in range(self.groups):
            part = order[cuts[k] : cuts[k + 1]]
            if len(part):
                rows.append([k, name, *[c[part].tobytes() for c in (own, *columns)]])
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        self.__init__(self.groups)
        return pa.RecordBatch.from_arrays(arrays, ["part", "block", "owners", "grams", "high", "low"])


def unique_counts(texts: DataFrame, size: int, step: int, steps: int, groups: int) -> DataFrame:
    """``c`` and ``alone``: n-grams of the step's part of the space that no other class has.

    Cut hashes of n-grams can only make one look shared. Two classes that share an n-gram look
    like one if 40 bits of their hashes agree; then it counts as unique to both.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        name = TaskContext.get().partitionId() << 32
        packer = Owned(groups)
        for _, data, offsets in text_blocks(batches, column=0):
            classes: dict[int, np.ndarray] = {}
            for grams in sets_of(data, offsets, hasher, size):
                if len(grams):
                    classes[class_id(grams)] = grams[(grams >> U64(56)) % U64(steps) == U64(step)]
            if not classes:
                continue
            grams = np.concatenate(list(classes.values()))
            owners = np.repeat(np.arange(len(classes)), [len(g) for g in classes.values()])
            order = np.argsort(grams, kind="stable")
            grams, owners = grams[order], owners[order]
            first = np.ones(len(grams), dtype=bool)
            first[1:] = grams[1:] != grams[:-1]
            at = np.flatnonzero(first)
            several = np.diff(np.append(at, len(grams))) > 1
            packer.add(grams[at], np.where(several, -1, owners[at]), np.array(list(classes), np.int64))
            if packer.size >= PACKED_GRAMS:
                yield packer.rows(name)
                name += 1
        if packer.blocks:
            yield packer.rows(name)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            nothing = pa.array([b""] * table.num_rows, pa.binary())
            return pa.table(
                {"block": table["block"], "classes": table["owners"], "owners": nothing, "counts": nothing}
            )
        columns = {
            name: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
            for name, kind in (("owners", np.int32), ("grams", np.uint32), ("high", np.uint32), ("low", np.uint8))
        }
        source = np.repeat(np.arange(table.num_rows), [len(x) for x in columns["grams"]])
        owner, values, high, low = (np.concatenate(c) for c in columns.values())
        kind = (high.astype(U64) << U64(8)) | low
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        first = np.ones(len(ranked), dtype=bool)
        first[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(first)
        kind = kind[order]
        lone = np.minimum.reduceat(kind, starts) == np.maximum.reduceat(kind, starts)
        lone &= np.minimum.reduceat(owner[order], starts) >= 0
        alone = order[np.repeat(lone, np.diff(np.append(starts, len(ranked))))]
        blocks, owners, counts = [], [], []
        names = table.column("block").to_pylist()
        told, n = np.unique((source[alone] << 32) | owner[alone], return_counts=True)
        cuts = np.searchsorted(told >> 32, np.arange(table.num_rows + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            blocks.append(names[k])
            owners.append((told[part] & 0xFFFFFFFF).astype(np.int32).tobytes())
            counts.append(np.minimum(n[part], 65_535).astype(np.uint16).tobytes())
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "classes": pa.array([b""] * len(blocks), pa.binary()),
                "owners": pa.array(owners, pa.binary()),
                "counts": pa.array(counts, pa.binary()),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        classes = np.frombuffer(max(table.column("classes").to_pylist(), key=len), np.int64)
        alone = np.zeros(len(classes), np.int64)
        pairs = zip(table.column("owners").to_pylist(), table.column("counts").to_pylist(), strict=True)
        for owners, counts in pairs:
            np.add.at(alone, np.frombuffer(owners, np.int32), np.frombuffer(counts, np.uint16))
        return pa.table({"c": classes, "alone": alone})

    sent = in_batches(texts).mapInArrow(
        lean(send), "part long, block long, owners binary, grams binary, high binary, low binary"
    )
    found = sent.groupBy("part").applyInArrow(
        lean_group(search), "block long, classes binary, owners binary, counts binary"
    )
    by_block = found.groupBy("block").applyInArrow(lean_group(total), "c long, alone long")
    # Copies in several blocks each have all lone n-grams of their class.
    return by_block.groupBy("c").agg(F.max("alone").alias("alone"))


def enough(overlap: Column, percent: int) -> Column:
    """Whether an overlap links two sets of ``nx`` and ``ny`` n-grams."""
    return 100 * overlap >= percent * (F.col("nx") + F.col("ny") - overlap)


def possible(percent: int) -> Column:
    """Whether a pair may be linked if this is the first n-gram of the order that both have: then
    they share at most what the shorter rest of the two orders holds, this one included. A linked
    pair passes where its first common n-gram stands, so none is lost."""
    return enough(F.least("rx", "ry"), percent)


def least_overlap(percent: int) -> Column:
    """N-grams of a set that any linked set must have."""
    return F.floor((percent * F.col("n") + 99) / 100)


def chosen(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Documents whose id is listed (``id``); a proven short list is broadcast."""
    ids = ids.select(F.col("id").alias("wanted"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_column].eqNullSafe(ids["wanted"]), "left_semi")


def class_grams(docs: DataFrame, size: int) -> DataFrame:
    """One row ``s``, ``c``, ``n`` for each n-gram of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for _, data, offsets in text_blocks(batches, column=0):
            sets = [g for g in sets_of(data, offsets, hasher, size) if len(g)]
            if sets:
                counts = np.array([len(g) for g in sets])
                classes = np.array([class_id(g) for g in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sets).astype(np.int64)),
                        pa.array(np.repeat(classes, counts)),
                        pa.array(np.repeat(counts, counts)),
                    ],
                    ["s", "c", "n"],
                )

    return in_batches(docs).mapInArrow(lean(scan), "s long, c long, n long")


def interval(low: int, high: int, upper: bool) -> Column:
    """The n-grams of a class within one fragment of the global order."""

    def inside(g: Column) -> Column:
        half = g["s"] >= 0 if upper else g["s"] < 0
        return g["o"].between(low, high - 1) & half

    return F.transform(F.filter("grams", inside), lambda g: g["s"])


def linked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar; partial overlaps are summed over fragments."""
    cuts = [(0, 2), (2, 4), (4, 7), (7, 64)]
    fragments = F.array(
        *[
            F.struct(
                F.lit(2 * k + half).alias("f"), interval(low, high, bool(half)).alias("grams")
            )
            for k, (low, high) in enumerate(cuts)
            for half in (0, 1)
        ]
    )
    parts = classes.select("c", "n", F.inline(fragments).alias("f", "grams"))
    parts = parts.where(F.size("grams") > 0)
    x = parts.select(F.col("c").alias("a"), F.col("n").alias("nx"), "f", F.col("grams").alias("gx"))
    y = parts.select(F.col("c").alias("b"), F.col("n").alias("ny"), "f", F.col("grams").alias("gy"))
    counted = pairs.select("a", "b").join(x, "a").join(y, ["b", "f"])
    counted = counted.groupBy("a", "b").agg(
        F.sum(F.size(F.array_intersect("gx", "gy"))).alias("overlap"),
        F.first("nx").alias("nx"),
        F.first("ny").alias("ny"),
    )
    return counted.where(enough(F.col("overlap"), percent)).select("a", "b")


def links(docs: DataFrame, sets: DataFrame, id_column: str, size: int, percent: int) -> DataFrame:
    """Edges ``a``, ``b`` between classes that connect every component."""
    classes = sets.where("n > 0").groupBy("c").agg(
        F.first("n").alias("n"), F.min("id").alias("id"), F.lit(0).cast("long").alias("alone")
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    groups = max(4, -(-total // (PASSES * GROUP_GRAMS)))
    needed = least_overlap(percent)
    allowed = F.col("n") - needed
    texts = docs.select("text")
    for step in range(PASSES):
        alone = unique_counts(texts, size, step, PASSES, groups).withColumnRenamed("alone", "more")
        classes = classes.join(alone, "c", "left").select(
            "c", "n", "id", (F.col("alone") + F.coalesce("more", F.lit(0))).alias("alone")
        )
        classes = written(classes.where(F.col("alone") <= allowed), "classes")
        texts = chosen(docs, classes, id_column).select("text")

    grams = written(class_grams(texts, size).join(classes.select("c"), "c", "left_semi"), "grams")
    shared = grams.groupBy("s").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("df")
    )
    shared = shared.where("low != high").select("s", F.log2("df").cast("int").alias("o"))
    ordered = (
        grams.join(shared, "s")
        .groupBy("c")
        .agg(
            F.array_sort(F.collect_set(F.struct("o", "s"))).alias("grams"),
            F.first("n").alias("n"),
        )
        .withColumn("r", F.size("grams").cast("long"))
    )
    ordered = written(ordered.where(F.col("r") >= needed), "ordered")
    # A linked pair shares one of the first n-grams: those alone come first in the order.
    length = (F.col("r") - needed + 1).cast("int")
    prefix = ordered.select("c", "n", "r", F.posexplode(F.slice("grams", F.lit(1), length)))
    # From here on r is what is left of the order from the n-gram on.
    prefix = prefix.select("c", "n", (F.col("r") - F.col("pos")).alias("r"), F.col("col.s").alias("s"))
    prefix = written(prefix, "prefix")
    centres = prefix.groupBy("s").agg(
        F.max(F.struct((F.col("r") / F.col("n")).alias("share"), "c", "n", "r")).alias("m"),
        F.count("*").alias("members"),
    )
    centres = centres.where("members > 1").select(
        "s", F.col("m.c").alias("b"), F.col("m.n").alias("ny"), F.col("m.r").alias("ry")
    )
    member = prefix.select("s", F.col("c").alias("a"), F.col("n").alias("nx"), F.col("r").alias("rx"))
    first = member.join(centres, "s").where((F.col("a") != F.col("b")) & possible(percent))
    first = written(pair(first), "pairs")
    edges = written(linked(first, ordered, percent), "links")

    label = components(edges).withColumnRenamed("node", "c")
    prefix = prefix.join(label, "c", "left").withColumn("l", F.coalesce("label", "c"))
    prefix = written(prefix.select("s", "c", "n", "r", "l"), "labelled")
    mixed = prefix.groupBy("s").agg(
        F.min("l").alias("low"), F.max("l").alias("high"), F.count("*").alias("members")
    )
    salts = F.ceil(F.col("members") / BUCKET_ROWS).cast("int").alias("salts")
    open_rows = prefix.join(mixed.where("low != high").select("s", salts), "s")
    # Linked sets differ in size by less than a band, so each meets those of its own band and of
    # the two beside it. The members of a large bucket are dealt out by salts on one side.
    band = F.floor(F.log("n") / (math.log(100 / min(percent, 99)) * (1 + 1e-9))).cast("int")
    a = open_rows.select(
        "s", F.col("c").alias("a"), F.col("n").alias("nx"), F.col("r").alias("rx"), F.col("l").alias("la"),
        band.alias("band"), F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"),
    )
    b = open_rows.select(
        "s", F.col("c").alias("b"), F.col("n").alias("ny"), F.col("r").alias("ry"), F.col("l").alias("lb"),
        F.explode(F.array(band - 1, band, band + 1)).alias("band"), "salts",
    )
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    across = a.join(b, ["s", "band", "salt"]).where((F.col("la") < F.col("lb")) & possible(percent))
    across = written(pair(across).join(first, ["a", "b"], "left_anti"), "pairs")
    return edges.unionByName(linked(across, ordered, percent))


def pair(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """Per document: id, ``n_shingles`` and ``component_id``, the smallest id of its component."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = document_sets(texts, ["id"], "text", size)
    sets = written(found.select(F.col("row.id").alias("id"), "n", "c"), "sets")
    edges = links(texts, sets, "id", size, percent)
    label = components(edges).withColumnRenamed("node", "c")
    classes = sets.where("n > 0").groupBy("c").agg(F.min("id").alias("low"))
    classes = classes.join(label, "c", "left").withColumn("l", F.coalesce("label", "c"))
    lows = classes.groupBy("l").agg(F.min("low").alias("component"))
    of_class = classes.join(lows, "l").select("c", "component")
    filled = sets.where("n > 0").join(of_class, "c").select("id", "n", "component")
    empty = sets.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return filled.unionByName(empty).select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component, the one with the smallest id, then the smallest
    hash of its text; null ids come last.

    A row is known by its id and the hash of its text, so different texts may share an id, null
    included. Rows without words, and rows that are linked with none, stay as they are. Only ids
    and hashes take the way over a shuffle.
    """
    texts = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text"
    )
    found = document_sets(texts, ["id", "h"], "text", STAGE_SHINGLE)
    sets = written(found.select("row.id", "row.h", "n", "c"), "sets")
    edges = links(texts, sets, "id", STAGE_SHINGLE, STAGE_PERCENT)
    label = components(edges).withColumnRenamed("node", "c")
    row = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    filled = sets.where("n > 0")
    classes = filled.groupBy("c").agg(F.min(row).alias("low"), F.count("*").alias("rows"))
    classes = classes.join(label, "c", "left").withColumn("l", F.coalesce("label", "c"))
    kept = classes.groupBy("l").agg(F.min("low").alias("kept"), F.sum("rows").alias("rows"))
    kept = kept.where("rows > 1").select("l", "kept")
    of_class = written(classes.join(kept, "l").select("c", "kept"), "kept")
    same = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("h") == F.col("kept.h"))
    linked_rows = filled.join(of_class, "c").groupBy("id", "h").agg(
        F.first(same).alias("stays"), F.count("*").alias("rows")
    )
    # Rows to be dropped, and kept rows that are there several times.
    touched = written(linked_rows.where("not stays or rows > 1"), "touched")

    def known(listed: DataFrame) -> tuple[DataFrame, Column]:
        if listed.count() <= BROADCAST_ROWS:
            listed = F.broadcast(listed)
        return listed, docs["doc_id"].eqNullSafe(listed["id"]) & (
            F.xxhash64(docs["text"]) == listed["h"]
        )

    rest = docs.join(*known(touched.select("id", "h")), "left_anti")
    again = touched.where("stays").select("id", "h")
    if again.isEmpty():
        return rest
    several = docs.join(*known(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(several)
