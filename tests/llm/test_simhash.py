import random
import re

import pytest
import xxhash

from fareline.llm import simhash


def brute_print(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """The smallest member of each print's group."""
    nodes = sorted(set(prints))
    parent = {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {f: root(f) for f in nodes}


def brute(docs):
    prints = [brute_print(t) for _, t in docs]
    group = brute_groups(prints)
    low = {}
    for (doc, _), f in zip(docs, prints, strict=True):
        if doc is not None:
            low[group[f]] = min(low.get(group[f], doc), doc)
    return [(doc, f"{f:016x}", low.get(group[f])) for (doc, _), f in zip(docs, prints, strict=True)]


def texts(draw):
    names = [f"w{k}" for k in range(50)]
    base = [[draw.choice(names) for _ in range(draw.choice([1, 2, 3, 40, 200]))] for _ in range(10)]
    for k in range(200):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice(names)
        yield k, draw.choice([" ", "\n", " \t"]).join(words)


@pytest.mark.parametrize("crowd", [128, 3])
def test_as_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "CROWDED_DOCUMENTS", 10 * crowd)
    docs = list(texts(random.Random(5)))
    docs += [(400, None), (401, ""), (402, " \n"), (403, "É w1 W2"), (404, "É W1 w2"), (405, "w1 w2")]
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, "only here"), (406, "word w7 w8 " * 9000)]
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, f long")
    found = [tuple(r) for r in simhash.near_duplicates(table.repartition(5)).collect()]
    assert sorted(found, key=str) == sorted(brute(docs), key=str)


def around(draw, count):
    """Fingerprints close to few centres, so that many share their segments."""
    centres = [draw.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    for _ in range(count):
        f = draw.choice(centres)
        for _ in range(draw.randrange(9)):
            f ^= 1 << draw.choice([draw.randrange(64), draw.randrange(12)])
        yield f


@pytest.mark.parametrize("crowd", [128, 8, 2])
def test_links_at_each_level(spark, monkeypatch, crowd):
    """Every pair of at most two differing bits is found, at whatever level its segments are."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = sorted(set(around(random.Random(crowd), 900)))
    table = spark.createDataFrame([(simhash.signed(f),) for f in prints], "f long")
    found = {
        tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(table).distinct().collect()
    }
    wanted = {(a, b) for k, b in enumerate(prints) for a in prints[:k] if (a ^ b).bit_count() <= 2}
    assert found == wanted


def test_each_link_found_once_under_a_segment(spark):
    table = spark.createDataFrame([(0,), (1,), (3,), (-1,), (1 << 40,)], "f long")
    rows = sorted(tuple(sorted(r)) for r in simhash.links(table).collect())
    # 1 and 2^40 differ in both halves by one bit; the others share one half.
    assert rows == [(0, 1)] * 2 + [(0, 3)] + [(0, 1 << 40)] * 2 + [(1, 3)] * 2 + [(1, 1 << 40)] * 2


def test_segments_cover_two_bits():
    """Whatever two bits differ, one segment of each level holds at most one of them, along one path."""
    for a in range(64):
        for b in range(64):
            for k, half in enumerate(simhash.LEVELS[0]):
                if (a in half) + (b in half) <= 1:
                    fits = [j for j in (2 * k, 2 * k + 1) if sum(x in simhash.LEVELS[1][j] for x in {a, b}) <= 1]
                    assert fits
                    assert any(
                        sum(x in simhash.LEVELS[2][i] for x in {a, b}) <= 1 for j in fits for i in (2 * j, 2 * j + 1)
                    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
