import random
import re
from collections import Counter

import numpy as np

from fareline.llm import quality_rules as rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, equal = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            equal += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marked.update((k, k + 1, k + 2))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, equal, len(marked)


def test_counts_as_brute_force(spark):
    draw = random.Random(3)
    parts = ["a", "b", "é#", "Z|", "  ", "\n", "\n", "日本 ", " ", "\t", "\r\n"]
    docs = [(k, "".join(draw.choices(parts, k=draw.randint(0, 80))), 1) for k in range(400)]
    docs += [(500, None, 1), (501, "", 1), (502, "\n", 1), (503, " ", 1), (None, "a b a b a b", 1)]
    docs += [(7, docs[7][1], 2), (600, "w " * 30_000, 1), (601, "x" * 50_000, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, row long").repartition(3)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = rules.statistics(table, ["doc_id", "row"])
    got = [(r["row"]["doc_id"], *[r[n] for n in names]) for r in found.collect()]
    expected = [(doc, *brute(text)) for doc, text, _ in docs]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_learns_a_conjunction():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.95)
    names = ["mean_word", "symbol_share", "digit_share"]
    found = rules.learn(x, bad, names)
    caught = np.zeros(len(x), dtype=bool)
    for rule in found:
        caught |= rules.covers(rule, x, names)
    assert (caught == bad).mean() > 0.98


def test_nothing_to_learn():
    assert rules.learn(np.zeros((0, 1)), np.zeros(0, bool), ["mean_word"]) == []
    assert rules.learn(np.ones((9, 1)), np.zeros(9, bool), ["mean_word"]) == []
    assert rules.learn(np.ones((9, 1)), np.ones(9, bool), ["mean_word"]) == []


def test_held_out_labels(spark):
    """Rules from one half of the labels judge the other half."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = rules.learn_rules(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id")
    judged = rules.judged(held, found, ["doc_id", "quality"]).where("not base_failed")
    rows = judged.selectExpr("row.quality = 1 as good", "kept").groupBy("good", "kept").count()
    counts = {(r.good, r.kept): r["count"] for r in rows.collect()}
    right = counts.get((True, True), 0) + counts.get((False, False), 0)
    assert right >= 0.98 * sum(counts.values())
    assert counts.get((True, False), 0) <= 0.01 * sum(counts.values())


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "good words " * 5, 1), (None, None, None)], "doc_id long, text string, kept int"
    )
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (None, 0), (2, None)], "doc_id long, quality int"
    )
    found = rules.learn_rules(docs, labels)
    judged = rules.judged(docs, found, docs.columns).select("row.doc_id", "kept", "base_failed")
    assert {tuple(r) for r in judged.collect()} == {(1, False, True), (None, False, True)}
    assert rules.judged(docs.limit(0), []).collect() == []
    assert rules.learn_rules(docs, labels.limit(0)) == []


def test_rules_do_not_depend_on_the_order_of_rows(spark):
    """Ids with two different texts each; the same rows in reverse order give the same rules."""
    rows, labels = [], []
    for k in range(120):
        words = " ".join(f"word{(k * 7 + j) % 211}" for j in range(80))
        marks = " ".join(["!?" * (1 + k % 4)] * 60)
        rows += [(k, words), (k, f"{words} {marks}")]
        labels.append((k, k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    back = spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    one, other = (rules.learn_rules(d, known) for d in (docs, back))
    assert [[str(c) for c in rule] for rule in one] == [[str(c) for c in rule] for rule in other]
