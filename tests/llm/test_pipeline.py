"""The whole pipeline against plain Python, on documents that need every stage."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
from test_jaccard_join import brute as jaccard_groups
from test_pii import brute as personal_data
from tokenizers import Tokenizer

import corpus_pipeline

KINDS = ("EMAIL", "IP", "CARD", "PHONE")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passes_rules(text):
    """The base rule; without labels there are no learned ones."""
    words = words_of(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    return len(words) >= 50 and 100 * len(marked) <= 50 * len(words)


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def contaminated(text, items):
    found = benchmark_words(text)
    for item in items:
        own = benchmark_words(item)
        size = min(10, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        if any(tuple(found[k : k + size]) in windows for k in range(len(found) - size + 1)):
            return True
    return False


def masked(text):
    out, at = "", 0
    for start, kind, end in personal_data(text):
        if start >= at:
            out, at = f"{out}{text[at:start]}<{KINDS[kind]}>", end
    return out + text[at:]


def brute(docs, items):
    kept = [(k, t) for k, t in docs if passes_rules(t)]
    groups = jaccard_groups(kept, 5, 80)
    kept = [(k, t) for k, t in kept if (k, k) in {(g[0], g[2]) for g in groups}]
    kept = [(k, masked(t)) for k, t in kept if not contaminated(t, items)]
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in kept:
        ids = tool.encode(text, add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = tool.decode(ids, skip_special_tokens=False)
        out.append((doc, len(ids), sha, hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out)


def test_run_as_brute_force(spark, tmp_path):
    draw = random.Random(8)
    letters = "aeioulmnrst"
    names = ["".join(draw.choices(letters, k=draw.randrange(2, 8))) for _ in range(400)]
    items = [" ".join(draw.choices(names, k=14)) for _ in range(5)] + ["one two three"]
    docs = []
    for k in range(120):
        words = draw.choices(names, k=draw.choice([10, 49, 50, 80, 200]))
        if k % 9 == 0:
            words[5:5] = draw.choice(items).split()
        if k % 7 == 0:
            words[3:3] = ["mail", f"x{k}@example.org", "or", "10.0.0.7"]
        if k % 8 == 3 and docs:
            words = docs[draw.randrange(len(docs))][1].split()
            words[-1:] = ["changed"] if k % 2 else words[-1:]
        if k % 10 == 6:
            words = words[:4] * 30
        docs.append((k, draw.choice([" ", "\n"]).join(words)))
    docs += [(500, None), (501, "")]
    table = spark.createDataFrame([(*d, "en", "s", len(d[1] or "")) for d in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    wanted = brute(docs, items)
    assert 10 < len(wanted) < 80
    assert sorted(tuple(r)[:4] for r in found.collect()) == wanted
