import random
import re

import numpy as np
import pytest

from fareline.llm import jaccard_join
from fareline.llm.components import components


def brute(docs, size=4, percent=85):
    sets = []
    for _, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        sets.append(frozenset(grams or ([tuple(words)] if words else [])))
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k, (doc, _) in enumerate(docs):
        low[root(k)] = min(low.get(root(k), doc), doc)
    return sorted((doc, len(sets[k]), low[root(k)]) for k, (doc, _) in enumerate(docs))


@pytest.mark.parametrize("seed, size, percent", [(3, 4, 85), (8, 5, 80)])
def test_as_brute_force(spark, seed, size, percent):
    draw = random.Random(seed)
    names = [f"w{k}" for k in range(40)]
    base = [[draw.choice(names) for _ in range(draw.choice([2, 5, 20, 60, 120]))] for _ in range(12)]
    docs = []
    for k in range(250):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            at, kind = draw.randrange(len(words)), draw.random()
            if kind < 0.5:
                words[at] = draw.choice(names)
            elif kind < 0.7:
                words.insert(at, draw.choice(names))
            elif len(words) > 1:
                del words[at]
        docs.append((k, " ".join(words)))
    docs += [(400, None), (401, ""), (402, " \n"), (403, "w1"), (404, "W1"), (405, "w1 w2")]
    docs += [(5, docs[5][1]), (406, "long " + "text w7 w8 " * 5000), (407, "text w7 w8 " * 5000)]
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n long")
    found = jaccard_join.similar(table.repartition(5), size=size, percent=percent)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, size, percent)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar(docs).collect() == []


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"t{k}" for k in range(80))
    rows = [(1, text, "a"), (2, text, "b"), (3, text + " more", "c"), (4, "other words", "d")]
    rows += [(1, text, "a"), (6, None, "e"), (7, "", "f"), (None, "null id text here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, again string")
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, None], key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(7, 9), (9, 9)], "a long, b long")
    found = {r.node: r.label for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), 7: 7, 9: 7}


def test_stage_keeps_different_texts_of_one_id(spark):
    a, b, c, d, e = (" ".join(f"{name}{k}" for k in range(60)) for name in "abcde")
    rows = [(1, a), (1, b), (2, a), (2, e), (None, c), (None, d), (None, a), (None, d)]
    rows += [(5, ""), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((tuple(r) for r in jaccard_join.stage(spark, docs, "").collect()), key=str)
    wanted = [(1, a), (1, b), (2, e), (None, c), (None, d), (5, ""), (5, None), (5, "")]
    assert kept == sorted(wanted, key=str)


def test_clashing_columns(spark):
    """Other columns have the names that the join itself uses."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(k, text if k < 3 else f"{k} only", "x", 1, 2, "y", 3) for k in range(6)]
    names = "doc_id long, text string, id string, n int, c int, row string, s int"
    found = jaccard_join.similar(spark.createDataFrame(rows, names)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5)]


def packed_sizes(texts, groups):
    """Bytes of the rows that a task sends, by the number of parts, and of its owners' classes."""
    hasher, packer = jaccard_join.Hasher(), jaccard_join.Owned(groups)
    rows, names = 0, 0
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for lo in range(0, len(texts), 50):
        part = offsets[lo : lo + 51]
        block = data[part[0] : part[-1]]
        sets = {jaccard_join.class_id(g): g for g in jaccard_join.sets_of(block, part - part[0], hasher, 4)}
        grams = np.concatenate(list(sets.values()))
        owners = np.repeat(np.arange(len(sets)), [len(g) for g in sets.values()])
        packer.add(grams, owners, np.array(list(sets), np.int64))
    batch = packer.rows(0)
    for row in batch.to_pylist():
        if row["part"] < 0:
            names += len(row["owners"])
        else:
            rows += sum(len(row[n]) for n in ("owners", "grams", "high", "low"))
    return rows, names


def test_packed_bytes_do_not_depend_on_the_parts():
    draw = random.Random(4)
    texts = [" ".join(str(draw.random()) for _ in range(200)) + " " for _ in range(400)]
    few, many = packed_sizes(texts, 7), packed_sizes(texts, 1_875)
    assert few == many and few[0] == 13 * 400 * 197 and few[1] == 8 * 400
