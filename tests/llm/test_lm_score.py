import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareline.llm import lm_score


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        if not held(doc):
            counts.update(tokens(text))
    total, types = sum(counts.values()), len(counts)
    base = math.log10(total + 0.1 * (types + 1))
    out = []
    for doc, text in docs:
        found = tokens(text)
        score = sum(math.log10(counts[t] + 0.1) - base for t in found)
        out.append((doc, held(doc), len(found), sum(counts[t] > 0 for t in found), total, round(score, 6)))
    return sorted(out, key=str)


def test_base_score_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "list_size", lambda size: 50)
    draw = random.Random(4)
    names = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(draw.choices(names, weights, k=draw.randint(0, 60)))) for k in range(300)]
    docs += [(None, "a B"), (900, None), (7, "x y z"), (901, ""), (902, "w1 " * 20_000)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, block int")
    found = lm_score.score(table.repartition(4)).collect()
    got = [
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in found
    ]
    assert sorted(got, key=str) == brute(docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_score_as_brute_force(spark, monkeypatch):
    """The model's score of each text, token by token from its weights and counts."""
    monkeypatch.setattr(lm_score, "list_size", lambda size: 40)
    models = []
    train = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *given: models.append(train(*given)) or models[-1])
    draw = random.Random(2)
    names = [f"w{k}" for k in range(90)]
    docs = [(k, " ".join(draw.choices(names, [1 / (k + 1) for k in range(90)], k=draw.randrange(40)))) for k in range(200)]
    docs += [(500, None), (501, "new words here")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.score for r in lm_score.score(table).collect()}
    model = models[0]
    hasher = lm_score.Hasher()
    counts = Counter(t for doc, text in docs if not held(doc) for t in tokens(text))

    def code(token):
        raw = np.frombuffer((token or "").encode(), np.uint8)
        own = hasher.ranges(hasher.sums(raw), np.array([0]), np.array([len(raw)]))[0]
        return int(lm_score.END if token is None else own)

    number = {int(h): k for k, h in enumerate(model.words.hashes)}
    mass = np.bincount(model.words.classes, weights=model.words.counts, minlength=lm_score.CLASSES)
    unlisted = {t for t in counts if code(t) not in number}
    beyond = sum(counts[t] for t in unlisted) + 0.1 * (len(unlisted) + 1)
    share = len(model.weights) // lm_score.FEATURES
    one_mix = lambda x: int(lm_score.mix(np.array([x % 2**64], np.uint64))[0])
    for doc, text in docs:
        total, before = 0.0, [lm_score.BEFORE] * 3
        for token in tokens(text):
            three, two, one = before
            codes = [one_mix(one), one_mix(one + one_mix(two + 1)), one_mix(two + 2), one_mix(one + one_mix(three + 3))]
            z = model.bias + sum(model.weights[k * share + c % share].astype(float) for k, c in enumerate(codes))
            at = number.get(code(token))
            kind = 0 if at is None else model.words.classes[at]
            total += (z[kind] - np.log(np.exp(z).sum())) / math.log(10)
            inside = (counts[token] + 0.1) / beyond if at is None else model.words.counts[at] / mass[kind]
            total += math.log10(inside)
            before = [two, one, code(token)]
        assert found[doc] == pytest.approx(total, rel=1e-3, abs=1e-3), doc


def test_the_model_grows_with_its_input():
    sizes = [10**6, 10**9, 3 * 10**10, 10**14]
    rows, words = [[f(n) for n in sizes] for f in (lm_score.table_rows, lm_score.list_size)]
    assert rows == [2**12, 2**14, 2**17, 2**23] and words[-1] == 2**25 and words[0] == lm_score.LISTED
    # The changes of a round, two bytes a weight for each task, never outgrow the texts.
    for n, table in zip(sizes[1:], rows[1:], strict=True):
        tasks = lm_score.training_tasks(n, table)
        assert 8 < tasks and lm_score.ROUNDS * tasks * table * 2 * lm_score.CLASSES <= n


def test_class_probabilities_sum_to_one():
    draw = np.random.default_rng(1)
    words = lm_score.Words(
        draw.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(500, 0, -1), lm_score.classes_of(np.arange(500, 0, -1))
    )
    share = np.bincount(words.classes, weights=10 ** words.inside())
    assert np.allclose(share[1:], 1)
    rows = draw.integers(0, lm_score.ROWS, (lm_score.FEATURES, 40))
    table = draw.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32)
    logs = lm_score.log_softmax(rows, table, np.zeros(lm_score.CLASSES, np.float32))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)
    assert (words.find(words.hashes) == np.arange(500)).all()
    assert (words.find(words.hashes + np.uint64(1)) < 0).all()


def test_beats_the_base_on_held_out_text(spark):
    """Where words follow each other, the model must use it; elsewhere it must not lose."""
    draw = random.Random(6)
    names = [f"w{k}" for k in range(12)]
    docs = []
    for k in range(1500):
        at, words = draw.randrange(12), []
        for _ in range(60):
            at = (at + 1) % 12 if draw.random() < 0.8 else draw.randrange(12)
            words.append(names[at])
        docs.append((k, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    means = [F.sum(c) / F.sum("n_tokens") for c in ("base_score", "score")]
    base, score = lm_score.score(table).where("held_out").agg(*means).first()
    assert score > base + 0.2
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = lm_score.score(given).where("held_out").agg(*means).first()
    assert score > base


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(docs).collect() == []


def test_listed_words_are_those_of_exact_counts(spark):
    # "often" has the most uses of all, but in no partition is it among the most frequent words.
    rows = []
    for part in range(8):
        words = [f"p{part}w{k}" for k in range(60) for _ in range(3)] + ["often"] * 2
        rows.append((part, " ".join(words)))
    texts = spark.createDataFrame(rows, "id long, text string")
    lists = []
    for parts in (1, 8):
        dealt = texts.repartitionByRange(parts, "id")
        words, others = lm_score.listed_words(dealt, 2)
        lists.append((words.hashes.tolist(), words.counts.tolist(), others))
    assert lists[0] == lists[1]
    assert lists[0][1] == [1, 16, 3]
    # All 1,456 words and 8 end tokens, without the listed ones.
    assert lists[0][2] == 8 * (182 + 1) - 20
