import random

import pytest

public = pytest.importorskip("public_tokenizers")

from fareline.llm import bpe, token_counts  # noqa: E402


def test_sums_as_brute_force(spark):
    draw = random.Random(1)
    texts = ["word " * draw.choice([0, 1, 5, 5, 300, 2000, 2500]) for _ in range(80)] + [None, "", "x"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id int, text string, length int")
    sums = token_counts.with_sums(token_counts.histogram(docs.repartition(3), bpe.default_path()))
    tool = bpe.encoder(bpe.default_path())
    sizes = [len(tool.encode(t or "")) for t in texts]
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(sizes)
    for n, row in rows.items():
        assert row.docs == sizes.count(n) and row.tokens == n * row.docs
        assert row.docs_from == sum(s >= n for s in sizes)
        assert row.tokens_from == sum(s for s in sizes if s >= n)
        assert row.truncated_tokens == sum(min(s, n) for s in sizes)
        assert row.share_up_to == sum(s <= n for s in sizes) / len(sizes)
    for row in token_counts.at_limits(sums, [0, 7, 1024, 10**6]).collect():
        assert row.kept_tokens == sum(min(s, row.limit) for s in sizes)
        assert row.longer == sum(s > row.limit for s in sizes)
        assert (row.docs, row.tokens) == (len(sizes), sum(sizes))
    ordered = sorted(sizes)
    for row in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert row.length == next(s for s in ordered if sum(x <= s for x in sizes) >= row.share * len(sizes))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    sums = token_counts.with_sums(token_counts.histogram(docs, bpe.default_path()))
    assert sums.collect() == []
    assert token_counts.at_limits(sums, [5]).first().kept_tokens == 0
