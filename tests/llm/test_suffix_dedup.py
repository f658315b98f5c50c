import hashlib
import random

import numpy as np
import pytest

from fareline.llm import suffix_dedup

NO_ID = -(1 << 63)


def brute(docs):
    rows = sorted({(NO_ID if d is None else d, (t or "").encode()) for d, t in docs})
    first = {}
    for doc, text in rows:
        for at in range(len(text) - 99):
            first.setdefault(text[at : at + 100], (doc, at))
    out = {}
    for doc, text in rows:
        gone = bytearray(len(text))
        for at in range(len(text) - 99):
            if first[text[at : at + 100]] != (doc, at):
                gone[at : at + 100] = b"\1" * 100
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc, text] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    found = [(d, *out[NO_ID if d is None else d, (t or "").encode()]) for d, t in docs]
    return sorted(found, key=str)


@pytest.mark.parametrize("seed, piece", [(1, 8_000_000), (2, 300)])
def test_as_brute_force(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    draw = random.Random(seed)
    names = [f"w{k}" for k in range(60)] + ["é", "日本"]
    passages = [" ".join(draw.choices(names, k=draw.choice([20, 40, 100]))) for _ in range(15)]
    docs = []
    for k in range(120):
        parts = [
            draw.choice(passages)
            if draw.random() < 0.5
            else " ".join(draw.choices(names, k=draw.randint(1, 30)))
            for _ in range(draw.randint(0, 6))
        ]
        text = " ".join(parts)
        if draw.random() < 0.3 and text:
            at = draw.randrange(len(text))
            text = text[:at] + "X" + text[at + 1 :]
        docs.append((k, text))
    docs += [(500, None), (501, ""), (502, "a" * 700), (503, "ab" * 300), (504, "a" * 350)]
    docs += [(7, docs[7][1]), (None, passages[0]), (-3, passages[1]), (505, ("abc " * 40 + "x") * 5)]
    draw.shuffle(docs)
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int")
    # A piece applies to texts that are blocks of their own.
    monkeypatch.setattr(suffix_dedup, "text_blocks", limited(piece))
    found = suffix_dedup.dedup(table.repartition(6))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs)


def limited(piece):
    def blocks(batches, column, limit):
        from fareline.llm import arrays

        return arrays.text_blocks(batches, column, min(piece, limit))

    return blocks


def test_kept_bytes(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, "new " + text + " end")], "doc_id int, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs, with_text=True).collect()}
    assert kept == {1: text.encode(), 2: b"new  end"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(docs).collect() == []


@pytest.mark.parametrize("parts", [1, 4])
def test_equal_rows_are_one_document(spark, parts):
    draw = random.Random(5)
    texts = [" ".join(f"v{draw.randrange(900)}" for _ in range(60)) for _ in range(4)]
    docs = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1])]
    docs += [(2, texts[2]), (3, texts[2] + " " + texts[3]), (3, texts[2] + " " + texts[3])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    table = table.coalesce(1) if parts == 1 else table.repartition(parts)
    found = suffix_dedup.dedup(table)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs)


def test_a_hot_passage_is_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 20, raising=False)
    monkeypatch.setattr(suffix_dedup, "GROUP_STRETCHES", 20)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3_000)
    draw = random.Random(9)
    line = "the very common line that a third of all documents hold"
    docs = []
    for k in range(150):
        a, b = (" ".join(f"n{draw.randrange(10**6)}" for _ in range(20)) for _ in range(2))
        docs.append((k, f"{a} {line} {b}" if k % 2 else a))
    docs += [(900, docs[1][1][40:]), (901, docs[3][1]), (3, docs[3][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    search, together = suffix_dedup.window_search, suffix_dedup.bucket_search

    def bounded_windows(found):
        assert sum(map(len, found.column("size").to_pylist())) <= 60
        return search(found)

    def bounded_buckets(found):
        bucket = b"".join(found.column("bucket").to_pylist())
        names = [bucket[k : k + 4] for k in range(0, len(bucket), 4)]
        assert max(map(names.count, names)) <= 40
        return together(found)

    monkeypatch.setattr(suffix_dedup, "window_search", bounded_windows)
    monkeypatch.setattr(suffix_dedup, "bucket_search", bounded_buckets)
    found = suffix_dedup.dedup(table)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs)


def test_packed_bytes_go_with_the_stretches():
    """However many parts: 18 bytes a stretch, and at most 20 for its document, named once a row."""
    draw = np.random.default_rng(1)
    sizes = []
    for groups in (7, 1_875):
        packer = suffix_dedup.Packer(groups + 1)
        for _ in range(10):
            n, docs = 20_000, 300
            row = np.sort(draw.integers(0, docs, n))
            columns = [
                draw.integers(0, 1 << 32, n, np.uint32), draw.integers(0, 1 << 63, n, np.uint64),
                draw.integers(0, 1 << 20, n, np.uint32), np.ones(n, np.uint8), np.ones(n, np.uint8),
            ]
            ids = draw.integers(0, 1 << 40, docs)
            packer.add(draw.integers(0, groups, n).astype(np.int32), ids, ids, row, columns)
        rows = list(packer.rows())
        assert len(rows) == groups
        sizes.append(sum(len(x) for row in rows for x in row[1:]))
    assert sizes[0] >= 20 * 200_000 and sizes[1] <= 36 * 200_000
