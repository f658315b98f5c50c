import random
import re

import pytest

from fareline.llm import decontaminate


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size):
    windows = {}
    for name, text in items:
        found = words(text)
        for at in range(max(1, len(found) - size + 1) if found else 0):
            windows.setdefault(tuple(found[at : at + size]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        found, hit, names = words(text), set(), set()
        for at in range(len(found)):
            for n in {len(w) for w in windows}:
                key = tuple(found[at : at + n])
                if len(key) == n and key in windows:
                    hit.update(range(at, at + n))
                    names |= windows[key]
        out.append((doc, len(found), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, block", [(10, 8_000_000), (3, 8_000_000), (10, 300)])
def test_as_brute_force(spark, size, block):
    draw = random.Random(3)
    parts = ["a", "b", "é", "Z9", "x", "日本", "q1"]

    def text(n):
        return " ".join(draw.choices(parts[: draw.choice([2, 7])], k=n))

    docs = [(k, text(draw.randint(0, 60))) for k in range(150)]
    docs += [(300, None), (301, ""), (5, "a b"), (5, "a b"), (None, "a b a b"), (7, "a-b, " * 3000)]
    items = [(k, text(draw.choice([0, 1, 3, 9, 10, 11, 14]))) for k in range(25)]
    items += [(None, "a b a"), (98, None), (97, "!!"), (3, items[3][1])]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(
        table.repartition(3), tests, window=size, query_bytes=block
    )
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()], key=str)
    assert got == brute(docs, items, size)


def test_places_and_longest(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(map(str, range(13))) + " y")], "doc_id int, text string")
    tests = spark.createDataFrame([("t", " ".join(map(str, range(20))))], "item_id string, text string")
    row = decontaminate.contamination(docs, tests).first()
    assert [(h["first"], h["end"]) for h in row.hits] == [(1, 14)]
    assert (row.n_hit, row.longest, row["items"]) == (13, 13, ["t"])


def longest_match(found, item, size):
    """Longest common stretch of at least a window (or the whole of a shorter item) by brute force."""
    best, least = None, min(size, len(item))
    for a in range(len(item)):
        for b in range(len(found)):
            n = 0
            while a + n < len(item) and b + n < len(found) and item[a + n] == found[b + n]:
                n += 1
            if least and n >= least and (best is None or (-n, b, a) < best):
                best = (-n, b, a)
    return best and (best[2], best[1], -best[0])


@pytest.mark.parametrize("block", [8_000_000, 200])
def test_longest_matches_as_brute_force(spark, block):
    draw = random.Random(9)
    items = [(k, " ".join(draw.choices("abc", k=draw.choice([2, 4, 9, 15])))) for k in range(12)]
    docs = []
    for k in range(80):
        own = draw.choices("abcx", k=draw.randrange(20))
        cut = draw.choice(items)[1].split()
        docs.append((k, " ".join(own + cut[: draw.randrange(1, 15)] + draw.choices("ab", k=5))))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(table, tests, window=4, query_bytes=block).collect()
    for row in found:
        own = words(docs[row.doc_id][1])
        wanted = {str(k): longest_match(own, words(t), 4) for k, t in items}
        wanted = {k: m for k, m in wanted.items() if m}
        assert {m["item"]: (m.item_first, m["first"], m.words) for m in row.matches} == wanted
        assert row.longest == max((m[2] for m in wanted.values()), default=0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), tests).collect() == []
    assert decontaminate.contamination(docs, tests.limit(0)).first().n_hit == 0


def test_stage_keeps_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = spark.createDataFrame(
        [(1, "x A B C", 5, "r"), (2, "a b", None, None), (3, None, 1, "s")],
        "doc_id long, text string, n_hit long, row string",
    )
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3}
