"""Quality rules learned as a decision list.

Statistics of whole texts are computed where the texts are read. Sequential covering learns from
labelled documents: a rule grows condition by condition (threshold on a statistic, largest gain
of information on one half of the examples) and is pruned from its end on the other half; the
documents it covers are taken out and the next rule is grown. The list becomes one ordered Spark
conditional expression.

A word is a maximal run of characters other than blank and 0x09 to 0x0D. Defined results: a null
or empty text has no words, fails the base rule and is not kept; a label that is null is not used,
of several labels of a document the worst counts, of several texts of an id the one with the least
hash is learned from; without labels of both kinds the list is empty
and only the base rule decides; other columns of the documents are carried on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.llm.arrays import (
    Hasher,
    in_batches,
    lean,
    mix,
    space_table,
    text_blocks,
    windows,
    word_spans,
)

#: Rules are learned from about this many labelled documents at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
MIN_WORDS = 50
U64 = np.uint64

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_chars",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_shouts",
    "n_distinct",
    "longest_word",
)

#: Statistics that rules test, from the counts: (name, numerator, denominator).
RATIOS = (
    ("mean_word", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("mark_share", "n_marks", "word_chars"),
    ("shout_share", "n_shouts", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
    ("longest_word", "longest_word", None),
)


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


def repeated_in_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its row holds it twice or more, and whether it stands earlier."""
    keys = mix(values + mix(rows.astype(U64) + U64(7)))
    _, first, inverse, counts = np.unique(
        keys, return_index=True, return_inverse=True, return_counts=True
    )
    later = np.ones(len(values), dtype=bool)
    later[first] = False
    return counts[inverse] > 1, later


def sums_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def block_counts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> dict[str, np.ndarray]:
    """The counts of each row of a block of texts."""
    rows = len(offsets) - 1
    starts, ends, firsts = word_spans(data, offsets, space_table())
    owner = np.repeat(np.arange(rows), np.diff(firsts))
    sums = hasher.sums(data)
    words = hasher.ranges(sums, starts, ends)
    out = {"n_words": np.diff(firsts)}
    lead = (data & 0xC0) != 0x80
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=chars[1:])
    out["n_chars"] = chars[offsets[1:]] - chars[offsets[:-1]]
    spaces = ~space_table()
    out["word_chars"] = out["n_chars"] - sums_by_row(spaces[data], offsets)
    for name, table in (
        ("n_symbols", byte_table(b"#*$%&|<>")),
        ("n_upper", byte_table(bytes(range(65, 91)))),
        ("n_digits", byte_table(bytes(range(48, 58)))),
        ("n_marks", byte_table(b"!\"'(),-./:;?[]_`{}~+=@^\\")),
    ):
        out[name] = sums_by_row(table[data], offsets)
    shout = data[ends - 1] == 33 if len(ends) else np.zeros(0, bool)
    out["n_shouts"] = sums_by_row(shout, firsts)
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, owner, chars[ends] - chars[starts])
    out["longest_word"] = longest
    _, later = repeated_in_row(words, owner)
    out["n_distinct"] = sums_by_row(~later, firsts)

    # Words in windows of three that the text holds twice or more.
    triples = windows(words, 3)
    at = np.flatnonzero(owner[: len(triples)] == owner[2:]) if len(triples) else np.zeros(0, int)
    twice, _ = repeated_in_row(triples[at], owner[at])
    marked = np.zeros(len(words), dtype=bool)
    for k in range(3):
        marked[at[twice] + k] = True
    out["n_repeat_words"] = sums_by_row(marked, firsts)

    # Lines that hold a word and equal an earlier line of their text.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_row + 1])
    broken = (line_ends > line_starts) & (data[line_ends - 1] == 10)
    line_ends = line_ends - broken
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_row = line_starts[filled], line_ends[filled], line_row[filled]
    _, later = repeated_in_row(hasher.ranges(sums, line_starts, line_ends), line_row)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    return out


def statistics(docs: DataFrame, columns: list[str], text_column: str = "text") -> DataFrame:
    """``row`` (a struct of the named columns) and the counts of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False)
        for batch, data, offsets in text_blocks(batches):
            found = block_counts(data, offsets, hasher)
            arrays = [pa.array(found[name], pa.int64()) for name in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", *COUNTS])

    texts = docs.select(F.struct(*columns).alias("row"), F.col(text_column).alias("text"))
    fields = [T.StructField(name, T.LongType()) for name in COUNTS]
    return in_batches(texts).mapInArrow(lean(count), T.StructType([texts.schema["row"], *fields]))


def ratio(name: str, top: str, bottom: str | None) -> Column:
    value = F.col(top).cast("double")
    if bottom is None:
        return value.alias(name)
    return F.when(F.col(bottom) > 0, value / F.col(bottom)).otherwise(0.0).alias(name)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        column = x[:, names.index(self.name)]
        return column > self.threshold if self.above else column <= self.threshold

    def expression(self) -> Column:
        top, bottom = next((t, b) for n, t, b in RATIOS if n == self.name)
        value = ratio(self.name, top, bottom)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    inside = np.ones(len(x), dtype=bool)
    for condition in rule:
        inside &= condition.holds(x, names)
    return inside


def best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain among the covered examples."""
    positives, total = int(y.sum()), len(y)
    best: tuple[float, Condition | None] = (0.0, None)
    if not positives or positives == total:
        return best
    prior = np.log2(positives / total)
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        values, hits = x[order, k], np.cumsum(y[order])
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        below = cuts + 1
        for above in (False, True):
            p = positives - hits[cuts] if above else hits[cuts]
            n = total - below if above else below
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - prior), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                middle = float((values[cuts[at]] + values[cuts[at] + 1]) / 2)
                best = (float(gain[at]), Condition(name, above, middle))
    return best


def learn(
    x: np.ndarray,
    bad: np.ndarray,
    names: list[str],
    max_rules: int = 24,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_covered: int = 5,
) -> list[Rule]:
    """Ordered rules for rejecting, by sequential covering with growing and pruning halves."""
    rules: list[Rule] = []
    half = np.arange(len(x)) % 3 > 0
    left = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules:
        grow, prune = left & half, left & ~half
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (~bad[inside]).any():
            _, condition = best_condition(x[inside], bad[inside], names)
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.holds(x, names)

        def worth(candidate: Rule, rows: np.ndarray = prune) -> float:
            inside = rows & covers(candidate, x, names)
            p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=worth)
        inside = left & covers(rule, x, names)
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def expression(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a text, from 1; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    chain = F
    for number, rule in enumerate(rules, 1):
        holds = rule[0].expression()
        for condition in rule[1:]:
            holds &= condition.expression()
        chain = chain.when(holds, F.lit(number))
    return chain


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    label_column: str = "quality",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """Rules from a bounded sample of the labelled documents."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).alias("label"))
    many = known.count()
    if many > sample_rows:
        share = int(sample_rows / many * (1 << 62))
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 62)) < share)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    texts = texts.join(F.broadcast(known), "id").groupBy("id").agg(
        F.first("label").alias("label"),
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"),
    )
    texts = texts.select("id", "label", F.col("least.text").alias("text"))
    names = [name for name, _, _ in RATIOS]
    sample = (
        statistics(texts, ["id", "label"])
        .where(~base_failed())
        .select("row.id", "row.label", *[ratio(*r) for r in RATIOS])
        .toPandas()
        .sort_values("id", ignore_index=True)
    )
    return learn(sample[names].to_numpy(float), sample["label"].to_numpy() == 0, names)


def judged(
    docs: DataFrame,
    rules: list[Rule],
    columns: list[str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The named columns, the counts, ``base_failed``, ``rule`` and ``kept`` of each document."""
    carried = [id_column] if columns is None else columns
    found = statistics(docs, carried, text_column)
    found = found.withColumn("base_failed", base_failed()).withColumn("rule", expression(rules))
    found = found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return found


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = judged(docs, rules, docs.columns).where("kept")
    return kept.select(*[F.col("row")[name].alias(name) for name in docs.columns])
