"""URL filters: host rules, then naive Bayes over segmented host names and path tokens.

Host names run words together. A unigram Viterbi search splits them into the words that page titles
and hyphenated names use. A multinomial naive Bayes model, trained on the urls that rules judge and
on those whose host holds a word of a short list of seeds, judges the other urls by their words. Urls
without either count as allowed with a small weight, so what is common everywhere tells nothing.
The last label of a host (its top-level domain) is no token.

A url that a rule judged is no evidence in the words that the rule itself names: they are why it has
its label.

All work is on distinct pairs of host and path. Word counts and token weights are joined, so no
vocabulary is held by the driver or a task; entries of hot keys are joined apart. A name takes time
in proportion to its letters.

Defined results: a null url, and one without ``://``, has an empty host and path and is judged by
the method, which has no token then and decides by the prior; ties are allowed; without training
urls everything is allowed; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.llm.joins import looked_up
from fareline.session import written

#: Host, path, verdict. Fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Host words that give a training url the label block.
SEEDS = (
    "ads", "adult", "bet", "bets", "casino", "gambling", "jackpot", "loans", "pills", "poker",
    "porn", "replica", "spam", "tracker", "track", "viagra", "warez", "xxx",
)
LONGEST_WORD = 20
#: Letters of a name whose substrings are listed at once.
STRETCH = 4096
#: Weight of a training url that neither a rule nor a seed judges.
PRESUMED = 0.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_and_path(url: str) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return lowered(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2)


def ruled(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # From the shortest to the longest, so that longer ones come out on top.
    for host, path, judged in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits &= F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def names_in(text: Column) -> Column:
    """Runs of letters, as an array without empty entries."""
    return F.filter(F.split(text, "[^a-z]+"), lambda w: w != "")


def unigrams(pages: DataFrame, pairs: DataFrame, source: str) -> DataFrame:
    """``word`` and ``n``: words of titles, of paths and of hyphenated host labels, and seeds."""
    title = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1)
    named = names_in(F.lower(title))
    hyphened = F.array_join(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), " ")
    others = F.concat(names_in(hyphened), names_in(lowered(F.col("path"))))
    seeds = pages.sparkSession.createDataFrame([(w,) for w in SEEDS], "word string")
    words = (
        pages.select(F.explode(named).alias("word"))
        .unionByName(pairs.select(F.explode(others).alias("word")))
        .unionByName(seeds)
    )
    words = words.where(F.length("word") <= LONGEST_WORD)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name; an unknown stretch costs more for each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            cost = costs.get(word, unknown + math.log(10) * len(word))
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def pieces_of(names: DataFrame) -> DataFrame:
    """``key`` and ``word``: the substrings of each name that could be a word, some repeated.

    Names are cut where they are, stretch by stretch, and known by their hash, so the rows grow with
    the name's letters alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, name in zip(keys, names, strict=True):
                for lo in range(0, len(name), STRETCH):
                    found = {
                        name[k : k + size]
                        for k in range(lo, min(lo + STRETCH, len(name)))
                        for size in range(1, LONGEST_WORD + 1)
                    }
                    words = pa.array(list(found), pa.string())
                    same = pa.repeat(pa.scalar(key, pa.int64()), len(words))
                    yield pa.RecordBatch.from_arrays([same, words], ["key", "word"])

    return names.select("key", "name").mapInArrow(cut, "key long, word string")


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name`` and ``words`` of each distinct name; each gets the counts of its own substrings."""
    total = words.agg(F.sum("n")).first()[0] or 1
    # Names of one hash would only be told of each other's words, which they don't hold.
    keyed = names.select(F.xxhash64("name").alias("key"), "name")
    known = pieces_of(keyed).join(words, "word").groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("word", "n"))).alias("known")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = math.log(total)
        for batch in batches:
            out = []
            for name, found in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                costs = {x["word"]: math.log(total / x["n"]) for x in found or []}
                out.append(viterbi(name, costs, unknown))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"]
            )

    rows = keyed.join(known, "key", "left").select("name", "known")
    return rows.mapInArrow(split, "name string, words array<string>")


def of_rule(rules: Sequence[tuple[str, str, str]], tokens: Column) -> Column:
    """The tokens of a url without those that the rule which judged it names itself: they are why
    the url has its label, not evidence for it."""
    out = tokens
    for host, path, _ in rules:
        named = [f"h:{w}" for label in host.split(".") for w in re.split("[^a-z]+", label) if w]
        named += [f"p:{w}" for w in re.split(r"[^\w#]+|_", re.sub("[0-9]+", "#", path.lower())) if w]
        if named:
            others = F.array(*[F.lit(t) for t in named])
            out = F.when(
                F.col("rule") == host + path, F.filter(tokens, lambda t: ~F.array_contains(others, t))
            ).otherwise(out)
    return out


def tokens(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``tokens``: words of the host, and of the path with digits as #."""
    hosts = pairs.select("host").distinct()
    labels = F.split("host", r"\.")
    upper = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), ".")
    names = hosts.select("host", F.explode(names_in(upper)).alias("name"))
    names = written(names, "names")
    split = segmented(names.select("name").distinct(), words)
    of_host = looked_up(names, written(split, "words-of-names"), ["name"]).groupBy("host").agg(
        F.sort_array(F.flatten(F.collect_list("words"))).alias("host_words")
    )
    without = hosts.join(names, "host", "left_anti")
    empty = F.array().cast("array<string>").alias("host_words")
    of_host = written(of_host.unionByName(without.select("host", empty)), "hosts")
    path = F.regexp_replace(lowered(F.col("path")), "[0-9]+", "#")
    parts = F.filter(F.split(path, r"[^\p{L}#]+"), lambda w: w != "")
    marked = F.concat(
        F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)),
        F.transform(parts, lambda w: F.concat(F.lit("p:"), w)),
    )
    found = looked_up(pairs, of_host, ["host"])
    return found.select("host", "path", "pages", marked.alias("tokens"))


def weights(labelled: DataFrame) -> tuple[DataFrame, float]:
    """``token`` and its log odds for block, and the log odds of the classes."""
    is_block = F.col("label") == "block"
    counts = labelled.agg(
        F.coalesce(F.sum(F.when(is_block, F.col("pages"))), F.lit(0.0)),
        F.coalesce(F.sum(F.when(~is_block, F.col("pages"))), F.lit(0.0)),
    ).first()
    prior = math.log((counts[0] + 1) / (counts[1] + 1))
    by_token = labelled.select(F.explode("tokens").alias("token"), "label", "pages")
    by_token = by_token.groupBy("token").agg(
        F.sum(F.when(is_block, F.col("pages")).otherwise(0.0)).alias("b"),
        F.sum(F.when(~is_block, F.col("pages")).otherwise(0.0)).alias("a"),
    )
    by_token = written(by_token, "tokens")
    total = by_token.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    b, a, n = (x or 0 for x in total)
    odds = F.log((F.col("b") + 1) / (b + n + 1)) - F.log((F.col("a") + 1) / (a + n + 1))
    return by_token.select("token", odds.alias("odds")), prior


def judge(
    pages: DataFrame,
    id_column: str = "page_id",
    url: str = "url",
    source: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Per page: id, host, path, rule and verdict, and ``odds``, the method's log odds to block."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    pairs = written(rows.groupBy("host", "path").agg(F.count("*").alias("pages")), "pairs")
    words = written(unigrams(pages, pairs, source), "words")
    found = written(tokens(pairs, words), "tokens")
    rule, verdict = ruled(rules)
    found = found.withColumn("rule", rule).withColumn("judged", verdict)
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"h:{w}") for w in SEEDS]))
    label = F.when(seeded, F.lit("block")).otherwise(F.coalesce("judged", F.lit("allow")))
    sure = seeded | F.col("judged").isNotNull()
    share = F.col("pages") * F.when(sure, 1.0).otherwise(PRESUMED)
    evidence = of_rule(rules, F.col("tokens")).alias("tokens")
    odds, prior = weights(found.select(evidence, label.alias("label"), share.alias("pages")))
    told = found.select("host", "path", F.explode("tokens").alias("token"))
    scores = (
        looked_up(told, odds, ["token"])
        .groupBy("host", "path")
        .agg(F.round(F.sum("odds"), 9).alias("sum"))
    )
    result = found.join(scores, ["host", "path"], "left").select(
        "host",
        "path",
        "rule",
        (F.coalesce("sum", F.lit(0.0)) + prior).alias("odds"),
        "judged",
    )
    result = written(result, "judged")
    verdict = F.coalesce("judged", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return looked_up(rows, result, ["host", "path"]).select(
        F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "odds"
    )
