"""Language-model scoring with a hashed maximum-entropy model.

A token's probability is that of its class, given features of the tokens before it, times that of
the token within its class. The class model is a softmax over hashed features: the last token, the
last two, the one before the last, and the pair of the third and the last (skips). It is trained by
distributed gradient updates: each round deals a share of the training texts to tasks, every task
takes steps from the common weights, and the weighted mean of the changes is the next common state.
All training texts are used, each in one round.

The most frequent words have classes of their own or share classes of about equal mass; all other
words are one class. The list of frequent words and the rows of the weight table grow with the root
of the training bytes, as a vocabulary does; the counts of all words cover the whole corpus. Frequent words are counted and scored where the text is read, the
others are sent to the part of their hash, so no part depends on a hot word: a word beyond the list
is no more frequent than any word on it.

A word is a maximal run of characters other than blank and 0x09 to 0x0D, with A-Z as a-z; each
text ends with one more token. Defined results: a null or empty text is its end token alone; a null
id counts as the empty text for the choice of held-out documents, other ids are integers; repeated
rows are repeated texts; without training texts every token has the same probability under the base
formula, and the model is the uniform one; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.llm.arrays import (
    Hasher,
    in_batches,
    lean,
    lean_group,
    mix,
    space_table,
    text_blocks,
    word_spans,
)
from fareline.session import written

U64 = np.uint64
#: Frequent words of the model and rows of its weight table, at least; both grow with the root of
#: the training bytes, about as vocabularies do. Its classes.
LISTED, ROWS = 65_536, 1 << 12
CLASSES = 32
#: So many of the most frequent words are classes of their own.
SINGLE = 14
FEATURES = 4
ROUNDS = 3
BATCH = 8_192
RATE = 0.15
END = 0x5851F42D4C957F2D
BEFORE = 0x14057B7EF767814F
#: Stands for all tokens together where words are counted.
ALL = 0x2545F4914F6CDD1D
GROUP_BYTES = 48_000_000
ADD = 0.1


def tokens_of(
    data: np.ndarray, offsets: np.ndarray, hasher: Hasher
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, texts one after the other, and the bounds of the texts."""
    starts, ends, rows = word_spans(data, offsets, space_table())
    words = hasher.ranges(hasher.sums(data), starts, ends)
    bounds = rows + np.arange(len(rows))
    out = np.empty(len(words) + len(rows) - 1, dtype=U64)
    last = bounds[1:] - 1
    is_word = np.ones(len(out), dtype=bool)
    is_word[last] = False
    out[is_word] = words
    out[last] = U64(END)
    return out, bounds


@dataclass
class Words:
    """The listed words: hashes, counts they were chosen by, and their classes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def __post_init__(self):
        bits = max(20, 4 + int(len(self.hashes)).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        place = (self.hashes & self.mask).astype(np.int64)
        self.slots[place[::-1]] = np.arange(len(self.hashes), dtype=np.int32)[::-1]
        lost = self.slots[place] != np.arange(len(self.hashes))
        self.more = np.flatnonzero(lost)
        self.more = self.more[np.argsort(self.hashes[self.more])]
        self.crowded = np.zeros(1 << bits, dtype=bool)
        self.crowded[place[lost]] = True

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Number of each token's word, or -1."""
        place = (tokens & self.mask).astype(np.int64)
        at = self.slots[place].astype(np.int64)
        at[(at >= 0) & (self.hashes[at] != tokens)] = -1
        if len(self.more):
            again = np.flatnonzero((at < 0) & self.crowded[place])
            others = self.hashes[self.more]
            near = np.minimum(np.searchsorted(others, tokens[again]), len(others) - 1)
            hit = others[near] == tokens[again]
            at[again[hit]] = self.more[near[hit]]
        return at

    def inside(self) -> np.ndarray:
        """log10 of each listed word's share of its class."""
        mass = np.bincount(self.classes, weights=self.counts, minlength=CLASSES)
        return np.log10(self.counts / mass[self.classes])


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Classes of words in the order of their counts: 0 is for words that aren't listed."""
    out = np.empty(len(counts), dtype=np.int64)
    out[:SINGLE] = 1 + np.arange(min(SINGLE, len(counts)))
    rest = counts[SINGLE:].astype(float)
    if len(rest):
        bins = CLASSES - 1 - SINGLE
        middle = np.cumsum(rest) - rest / 2
        out[SINGLE:] = 1 + SINGLE + np.minimum(bins - 1, (middle / rest.sum() * bins).astype(int))
    return out


def table_rows(size_bytes: int) -> int:
    """Rows of the weight table for so many bytes of training text: a power of two."""
    return 1 << math.ceil(math.log2(math.sqrt(max(size_bytes, 4 * ROWS**2)) / 2))


def list_size(size_bytes: int) -> int:
    """Words of the list: four for each row of the table."""
    return max(LISTED, 4 * table_rows(size_bytes))


def feature_rows(tokens: np.ndarray, bounds: np.ndarray, table: int = ROWS) -> np.ndarray:
    """Rows of the weight table for each token, from the tokens before it."""
    size = len(tokens)
    padded = np.concatenate([np.full(3, BEFORE, U64), tokens])
    one, two, three = padded[2 : 2 + size], padded[1 : 1 + size], padded[:size]
    first = np.zeros(size, dtype=np.int64)
    first[bounds[:-1]] = 1
    since = np.arange(size) - bounds[:-1][np.cumsum(first) - 1]
    one = np.where(since >= 1, one, U64(BEFORE))
    two = np.where(since >= 2, two, U64(BEFORE))
    three = np.where(since >= 3, three, U64(BEFORE))
    codes = (mix(one), mix(one + mix(two + U64(1))), mix(two + U64(2)), mix(one + mix(three + U64(3))))
    share = table // FEATURES
    out = np.empty((FEATURES, size), dtype=np.int64)
    for k, code in enumerate(codes):
        out[k] = k * share + (code % U64(share)).astype(np.int64)
    return out


def log_softmax(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class probabilities of each token."""
    z = weights[rows[0]]
    for k in range(1, FEATURES):
        z += weights[rows[k]]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def train_on(rows: np.ndarray, target: np.ndarray, weights, bias, seen, steps) -> None:
    """Gradient steps over the tokens, in batches; ``seen`` counts the uses of each row."""
    for at in range(0, len(target), BATCH):
        r, y = rows[:, at : at + BATCH], target[at : at + BATCH]
        gap = np.exp(log_softmax(r, weights, bias))
        gap[np.arange(len(y)), y] -= 1.0
        for k in range(FEATURES):
            order = np.argsort(r[k], kind="stable")
            sorted_rows = r[k][order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = sorted_rows[1:] != sorted_rows[:-1]
            begin = np.flatnonzero(first)
            used = sorted_rows[begin]
            slope = np.add.reduceat(gap[order], begin, axis=0)
            steps[used] += np.square(slope).mean(axis=1)
            weights[used] -= RATE * slope / np.sqrt(1.0 + steps[used])[:, None]
            seen[used] += np.diff(np.append(begin, len(order)))


def is_held_out(id_column: str):
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text) % 10 == 0


def listed_words(train: DataFrame, limit: int = LISTED) -> tuple[Words, int]:
    """The most frequent words, by the counts of all words, and the number of all other tokens.
    The end token comes first. A task hands its counts on in parts, so it never holds many."""

    def counted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(words.astype(np.int64)), pa.array(counts, pa.int64())], ["w", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        words, counts, total = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for _, data, offsets in text_blocks(batches, column=0):
            tokens, _ = tokens_of(data, offsets, hasher)
            total += len(tokens)
            w, n = np.unique(tokens[tokens != U64(END)], return_counts=True)
            words, inverse = np.unique(np.concatenate([words, w]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(words) > 16 * limit:
                yield counted(words, counts)
                words, counts = words[:0], counts[:0]
        yield counted(np.append(words, U64(ALL)), np.append(counts, total))

    found = in_batches(train.select("text")).mapInArrow(lean(count), "w long, n long").groupBy("w")
    everything = int(np.array([ALL], U64).astype(np.int64)[0])
    first = F.desc(F.col("w") == everything)
    found = found.agg(F.sum("n").alias("n")).orderBy(first, F.desc("n"), "w").limit(limit + 1)
    top = found.toArrow()
    hashes, counts = np.array(top["w"]).astype(np.int64), np.array(top["n"]).astype(np.int64)
    order = np.lexsort((hashes, -counts, hashes != everything))
    total = int(counts[order[0]]) if len(order) else 0
    hashes, counts = hashes[order[1:]].astype(U64), counts[order[1:]]
    hashes, counts = np.append(U64(END), hashes).astype(U64), np.append(1, counts)
    return Words(hashes, counts, classes_of(counts)), max(0, total - int(counts.sum()))


def training_tasks(size_bytes: int, rows: int, rounds: int = ROUNDS) -> int:
    """Tasks of a round. Each sends a change of the whole table, of two bytes a weight, so with so
    many tasks the changes of all rounds together are about half as large as the texts."""
    return max(8, size_bytes // (rounds * rows * 4 * CLASSES))


def train_round(
    texts: DataFrame, words: Words, weights: np.ndarray, bias: np.ndarray, tasks: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights after a round, exact counts of the listed words in its texts, tokens by class."""
    slices, salts = 16, max(1, round(math.sqrt(tasks)))
    height = len(weights) // slices

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), weights.copy()
        seen, steps = np.zeros(len(weights)), np.zeros(len(weights))
        counts = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        for _, data, offsets in text_blocks(batches, column=0):
            tokens, bounds = tokens_of(data, offsets, hasher)
            number = words.find(tokens)
            counts += np.bincount(number + 1, minlength=len(counts))
            target = np.where(number >= 0, words.classes[number], 0)
            rows = feature_rows(tokens, bounds, len(weights))
            train_on(rows, target, own, bias, seen, steps)
        salt = TaskContext.get().partitionId() % salts
        kinds, uses, values = [], [], []
        for k in range(slices):
            rows = slice(k * height, (k + 1) * height)
            kinds.append(k)
            uses.append(seen[rows].astype(np.float32).tobytes())
            values.append((own[rows] - weights[rows]).astype(np.float16).tobytes())
        kinds.append(slices)
        uses.append(b"")
        values.append(counts.tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.int64()),
                pa.array([salt] * len(kinds), pa.int64()),
                pa.array(uses, pa.binary()),
                pa.array(values, pa.binary()),
            ],
            ["slice", "salt", "uses", "sums"],
        )

    def add(table: pa.Table, kind: type) -> pa.Table:
        """Sums of changes, those of ``kind`` float16 weighted by the uses of their rows."""
        counted = table.column("slice")[0].as_py() == slices
        total, used = None, np.zeros(0 if counted else height, np.float32)
        for use, x in zip(table.column("uses"), table.column("sums"), strict=True):
            if counted:
                value = np.frombuffer(x.as_buffer(), np.int64)
            else:
                own = np.frombuffer(use.as_buffer(), np.float32)
                value = np.frombuffer(x.as_buffer(), kind).reshape(height, CLASSES)
                value = value * own[:, None] if kind is np.float16 else value
                used += own
            total = value.copy() if total is None else total + value
        return pa.table(
            {
                "slice": table.column("slice").slice(0, 1),
                "salt": pa.array([0], pa.int64()),
                "uses": pa.array([used.tobytes()], pa.binary()),
                "sums": pa.array([total.tobytes()], pa.binary()),
            }
        )

    schema = "slice long, salt long, uses binary, sums binary"
    changes = in_batches(texts.select("text").coalesce(tasks)).mapInArrow(lean(learn), schema)
    # Sums meet in two levels, so no task holds the changes of all others.
    summed = changes.groupBy("slice", "salt").applyInArrow(
        lean_group(lambda table: add(table, np.float16)), schema
    )
    rows = summed.groupBy("slice").applyInArrow(
        lean_group(lambda table: add(table, np.float32)), schema
    )
    rows = rows.collect()
    new, counts = weights.copy(), np.zeros(len(words.hashes) + 1, dtype=np.int64)
    for row in rows:
        if row["slice"] == slices:
            counts = np.frombuffer(row["sums"], np.int64)
            continue
        value = np.frombuffer(row["sums"], np.float32).reshape(height, CLASSES)
        used = np.maximum(np.frombuffer(row["uses"], np.float32), 1.0)[:, None]
        new[row["slice"] * height : (row["slice"] + 1) * height] += value / used
    return new, counts[1:], counts[:1]


@dataclass
class Model:
    words: Words
    weights: np.ndarray
    bias: np.ndarray
    #: Exact counts of the listed words, and of all other tokens together.
    counts: np.ndarray
    other: int


def class_bias(words: Words, other: float) -> np.ndarray:
    mass = np.bincount(words.classes, weights=words.counts, minlength=CLASSES) + 0.5
    mass[0] += other
    return np.log(mass / mass.sum()).astype(np.float32)


def train(train_texts: DataFrame, size_bytes: int, rounds: int = ROUNDS) -> Model:
    """Model of training texts given as ``id`` and ``text``, of so many bytes."""
    words, others = listed_words(train_texts, list_size(size_bytes))
    weights = np.zeros((table_rows(size_bytes), CLASSES), dtype=np.float32)
    exact, other = np.zeros(len(words.hashes), dtype=np.int64), 0
    bias = class_bias(words, others)
    turn = F.pmod(F.xxhash64("id"), F.lit(rounds))
    tasks = training_tasks(size_bytes, len(weights), rounds)
    for k in range(rounds):
        texts = train_texts.where(turn == k)
        weights, counts, rest = train_round(texts, words, weights, bias, tasks)
        exact, other = exact + counts, other + int(rest[0])
    # The classes stay; within them the exact counts of all training texts decide.
    words = Words(words.hashes, np.maximum(exact, 1), words.classes)
    return Model(words, weights, bias, exact, other)


PACKED = "part long, block long, docs binary, words binary, times binary"


def scored(texts: DataFrame, model: Model, groups: int) -> DataFrame:
    """Per block one row (part -1) with the sums of its texts, and one row for each part that
    holds some of its words beyond the list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        inside = model.words.inside()
        known = np.log10(model.counts + ADD)
        task = TaskContext.get().partitionId() << 32
        for number, (batch, data, offsets) in enumerate(text_blocks(batches, column=2)):
            tokens, bounds = tokens_of(data, offsets, hasher)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            at = model.words.find(tokens)
            hit = at >= 0
            target = np.where(hit, model.words.classes[at], 0)
            rows = feature_rows(tokens, bounds, len(model.weights))
            logs = np.empty(len(tokens))
            for lo in range(0, len(tokens), BATCH):
                part = slice(lo, lo + BATCH)
                z = log_softmax(rows[:, part], model.weights, model.bias)
                logs[part] = z[np.arange(len(z)), target[part]]
            logs /= np.log(10)
            n = batch.num_rows
            sums = np.zeros((n, 6))
            sums[:, 0] = np.diff(bounds)
            sums[:, 1] = np.bincount(doc, weights=logs + np.where(hit, inside[at], 0.0), minlength=n)
            sums[:, 2] = np.bincount(doc, weights=np.where(hit, known[at], 0.0), minlength=n)
            sums[:, 3] = np.bincount(doc, weights=hit & (model.counts[at] > 0), minlength=n)
            sums[:, 4] = np.bincount(doc, weights=~hit, minlength=n)
            held = np.array(batch.column(1).to_pylist(), dtype=bool)
            sums[:, 5] = held
            out = [[-1, task + number, np.array(batch.column(0).to_numpy(), np.int64).tobytes(), sums.tobytes(), b""]]
            # Words beyond the list: once for each text, with how often.
            pair = tokens[~hit]
            owner = doc[~hit]
            order = np.lexsort((pair, owner))
            pair, owner = pair[order], owner[order]
            first = np.ones(len(pair), dtype=bool)
            first[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(first)
            times = np.diff(np.append(begin, len(pair)))
            pair, owner = pair[begin], owner[begin]
            # The sign of the text's number says whether it is held out.
            owner = np.where(held[owner], -1 - owner, owner)
            parts = (mix(pair + U64(5)) % U64(groups)).astype(np.int64)
            order = np.argsort(parts, kind="stable")
            cuts = np.searchsorted(parts[order], np.arange(groups + 1))
            for k in range(groups):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    out.append(
                        [
                            k, task + number, owner[own].astype(np.int32).tobytes(),
                            pair[own].tobytes(), times[own].astype(np.uint32).tobytes(),
                        ]
                    )
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                ["part", "block", "docs", "words", "times"],
            )

    return in_batches(texts).mapInArrow(lean(scan), PACKED)


def word_part(table: pa.Table) -> pa.Table:
    """Counts of a part's words in training texts, and what they add to each text of each block.
    The row of block -1 has the number of distinct words."""
    docs = [np.frombuffer(x, np.int32) for x in table.column("docs").to_pylist()]
    words = np.concatenate([np.frombuffer(x, U64) for x in table.column("words").to_pylist()])
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("times").to_pylist()])
    owner = np.concatenate(docs).astype(np.int64)
    _, inverse = np.unique(words, return_inverse=True)
    counts = np.bincount(inverse, weights=np.where(owner >= 0, times, 0))
    log, seen = np.log10(counts + ADD)[inverse] * times, (counts > 0)[inverse] * times
    owner = np.where(owner < 0, -1 - owner, owner)
    blocks, out_docs, sums = [-1], [b""], [np.array([float((counts > 0).sum())]).tobytes()]
    at = 0
    for block, own in zip(table.column("block").to_pylist(), docs, strict=True):
        part = slice(at, at + len(own))
        ids, place = np.unique(owner[part], return_inverse=True)
        both = [np.bincount(place, weights=v[part]) for v in (log, seen)]
        blocks.append(block)
        out_docs.append(ids.astype(np.int32).tobytes())
        sums.append(np.stack(both, axis=1).tobytes())
        at += len(own)
    return pa.table(
        {
            "part": pa.array([0] * len(blocks), pa.int64()),
            "block": pa.array(blocks, pa.int64()),
            "docs": pa.array(out_docs, pa.binary()),
            "words": pa.array(sums, pa.binary()),
            "times": pa.array([b""] * len(blocks), pa.binary()),
        }
    )


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"),
        is_held_out(id_column).alias("held_out"),
        F.col(text_column).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(texts.where(~F.col("held_out")), size)
    # A missing id travels as the smallest number beside a mark of its own.
    marked = texts.withColumn("id", F.coalesce("id", F.lit(-(1 << 63))))
    packed = written(scored(marked, model, max(4, -(-size // GROUP_BYTES))), "scored")
    of_parts = written(
        packed.where("part >= 0").groupBy("part").applyInArrow(lean_group(word_part), PACKED), "words"
    )
    distinct = sum(
        float(np.frombuffer(r["words"], np.float64)[0])
        for r in of_parts.where("block = -1").select("words").toLocalIterator()
    )
    total = int(model.counts.sum()) + model.other
    types = int((model.counts > 0).sum()) + int(distinct)
    base = np.log10(total + ADD * (types + 1))
    rest = np.log10(model.other + ADD * (distinct + 1))

    def finish(table: pa.Table) -> pa.Table:
        # The block's own row first; parts in a fixed order, so sums don't depend on the shuffle.
        own, parts = None, []
        for row in table.to_pylist():
            if row["part"] < 0:
                own = row
            else:
                parts.append(row)
        ids = np.frombuffer(own["docs"], np.int64)
        sums = np.frombuffer(own["words"], np.float64).reshape(len(ids), 6)
        more = np.zeros((len(ids), 2))
        for row in sorted(parts, key=lambda r: r["docs"] + r["words"]):
            more[np.frombuffer(row["docs"], np.int32)] += np.frombuffer(
                row["words"], np.float64
            ).reshape(-1, 2)
        n = sums[:, 0]
        return pa.table(
            {
                "id": pa.array(ids),
                "held_out": pa.array(sums[:, 5] > 0),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array((sums[:, 3] + more[:, 1]).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), total), pa.int64()),
                "base_score": pa.array(sums[:, 2] + more[:, 0] - n * base),
                "score": pa.array(sums[:, 1] + more[:, 0] - sums[:, 4] * rest),
            }
        )

    rows = packed.where("part < 0").unionByName(of_parts.where("block >= 0"))
    found = rows.groupBy("block").applyInArrow(
        finish,
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
    kind = docs.schema[id_column].dataType
    missing = F.col("id") == -(1 << 63)
    named = F.when(~missing, F.col("id")).cast(kind).alias(id_column)
    return found.select(named, *[c for c in found.columns if c != "id"])
