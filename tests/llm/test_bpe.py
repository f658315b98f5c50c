import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from fareline.llm import bpe  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "th", "er", "'", "'s", "'ll", " ", "  ", "\n", "1", "23", "é", "!", "l", "\t", "\x85",
    "<|endoftext|>", "日本", "　", "👍",
]


@pytest.fixture(scope="module")
def known():
    return tokenizers.Tokenizer.from_file(PATH)


def ids(known, text):
    return known.encode(text, add_special_tokens=False).ids


def random_texts(count, seed=5):
    draw = random.Random(seed)
    for k in range(count):
        weights = [
            [1 if p.isalpha() else 0 for p in PARTS],
            [20 if p.isalpha() else 1 for p in PARTS],
            [1] * len(PARTS),
        ][k % 3]
        yield "".join(draw.choices(PARTS, weights, k=draw.randint(0, 200)))


def test_tree_of_leaves_is_exact(known, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 40)
    tool = bpe.Encoder(PATH)
    for number, text in enumerate(random_texts(1500)):
        leaf = (7, 16, 33)[number % 3]
        leaves = [text[at : at + leaf] for at in range(0, len(text), leaf)]
        expected = ids(known, text)
        assert tool.tree([(x, tool.encode(x)) for x in leaves]) == expected, (text, leaf)
        assert tool.encode(text) == expected
        assert tool.decode(expected).decode() == known.decode(expected, skip_special_tokens=False)


def test_every_code_point_as_the_library(known):
    tool = bpe.encoder(PATH)
    for low in range(0, 0x30000, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c <= 0xDFFF]
        text = " ".join(f"a{c}b {c}{c}1{c}.{c}" for c in chars)
        assert tool.encode(text) == ids(known, text)


def test_long_unsplit_runs(known):
    tool = bpe.encoder(PATH)
    for text in ("abcdefghij" * 4000, "é" * 9000, "1" * 20_000, "a" * 5000 + " " + "b" * 9000):
        leaves = [text[at : at + 3000] for at in range(0, len(text), 3000)]
        assert tool.tree([(x, tool.encode(x)) for x in leaves]) == ids(known, text)


def test_documents(spark, known):
    texts = [*random_texts(60, seed=9), "x" * 5000, "word " * 3000, "", None]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(5, texts[5], 1), (None, "null id " * 40, 0)]
    rows += [(60, texts[60], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf long").repartition(3)
    found = bpe.encode(docs, PATH, leaf=64, with_ids=True).collect()
    assert len(found) == len(rows)
    expected = []
    for doc, text, _ in rows:
        tokens = ids(known, text or "")
        listed = ",".join(map(str, tokens))
        decoded = known.decode(tokens, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, decoded)]
        expected.append((doc, len(tokens), *digests))
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH).collect() == []
