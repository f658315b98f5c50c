import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fareline.llm import periodic_runs, queries


def brute_runs(words, shortest=12):
    """Every maximal stretch of every lag, without those of a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - i + q >= max(shortest, 2 * q):
                found.setdefault((i, end - i + q), q)
            i = max(end, i + 1)
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [
        w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)
    ]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc, len(runs), *best, milli, sha(listed), sha(" ".join(kept)))


def random_words(draw):
    words = [f"w{draw.randrange(draw.choice([2, 4, 30]))}" for _ in range(draw.randrange(60))]
    for _ in range(draw.randrange(4)):
        unit = [f"w{draw.randrange(6)}" for _ in range(draw.randrange(1, 9))]
        at = draw.randrange(len(words) + 1)
        words[at:at] = (unit * draw.randrange(2, 9))[: draw.randrange(8, 60)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_arrays_as_brute_force(seed):
    draw = random.Random(seed)
    texts = [random_words(draw) for _ in range(150)] + [[], ["a"] * 11, ["a"] * 12, ["a", "b"] * 40]
    values = np.random.default_rng(1).integers(0, 1 << 63, 64).astype(np.uint64)
    name = {w: values[k] for k, w in enumerate(sorted({w for t in texts for w in t}))}
    words = np.array([name[w] for t in texts for w in t], np.uint64)
    rows = np.cumsum([0, *[len(t) for t in texts]])
    found = periodic_runs.runs_of(words, rows)
    wanted = [(s + rows[k], z, q) for k, t in enumerate(texts) for s, z, q in brute_runs(t)]
    assert [tuple(int(x) for x in r) for r in found] == wanted
    starts, ends = rows[:-1], rows[1:]
    plain = [periodic_runs.plain_scan(words, int(a), int(b), 12) for a, b in zip(starts, ends, strict=True)]
    plain = np.concatenate(plain)
    assert sorted(map(tuple, plain.tolist())) == sorted(map(tuple, found.tolist()))


def test_misleading_hashes_are_found_out(monkeypatch):
    """With a hash that calls everything equal, verified results are the same."""
    words = np.array([1, 2, 3] * 6 + list(range(10, 22)) * 2 + [5, 5], np.uint64)
    rows = np.array([0, len(words)])
    wanted = brute_runs(words.tolist())
    monkeypatch.setattr(
        periodic_runs.Prefixes, "equal", lambda self, at, lag, size: np.ones(len(at), bool)
    )
    assert [tuple(int(x) for x in r) for r in periodic_runs.runs_of(words, rows)] == wanted


def test_segments_are_stable():
    words = np.array([1, 2, 9, 1, 2, 8, *[3, 4] * 7, 7, *[5, 6] * 6], np.uint64)
    starts, ends = periodic_runs.segments(words, np.array([0, len(words)]), 12)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(6, 20), (21, 33)]


def test_query_as_brute_force(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice([" ", "\n", "\t\x0b "]).join(random_words(draw))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "é ü " * 10), (1004, "A a " * 6)]
    rows += [(7, rows[7][1]), (1005, "x " * 4000), (1006, " ".join(f"u{k % 1999}" for k in range(4100)))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string")
    found = queries.run_digests(periodic_runs.with_periodic_tails(table.repartition(3)))
    wanted = sorted((brute_row(*r) for r in rows), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_given_documents_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    small = [r for r in rows if len((r[1] or "").split()) < 1500]
    wanted = {r[0]: brute_row(*r) for r in small}
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows) and {k: found[k] for k in wanted} == wanted


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b " * 8), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(table)).collect()
    assert sorted((len(r.runs), r.collapsed) for r in found) == [(0, ""), (1, "a b")]
    assert periodic_runs.periodic_runs(table.limit(0)).collect() == []


def test_long_text_in_little_time():
    """Half a million words with period 3, and as many with a period of a third."""
    words = np.tile(np.array([1, 2, 3], np.uint64), 60_000)
    assert periodic_runs.runs_of(words, np.array([0, len(words)])).tolist() == [[0, 180_000, 3]]
    unit = np.random.default_rng(2).integers(0, 1 << 60, 50_000).astype(np.uint64)
    words = np.tile(unit, 3)
    assert periodic_runs.runs_of(words, np.array([0, len(words)])).tolist() == [[0, 150_000, 50_000]]
