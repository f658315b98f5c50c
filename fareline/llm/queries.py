"""Registered queries of the subpackage; each digest is derived from its operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    html_extract,
    jaccard_join,
    lm_score,
    oracle,
    periodic_runs,
    pii,
    quality_rules,
    simhash,
    suffix_dedup,
    token_counts,
    url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_digest(values) -> F.Column:
    return F.sha2(F.array_join(values, ","), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.default_path())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.train(docs), ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed("good"), 256).alias("base_sha256"),
        pii.listed("all_spans").alias("spans"),
        (F.size("all_spans") - F.size("good")).cast("long").alias("n_added"),
        F.size("all_spans").cast("long").alias("n_spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        joined_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.with_sums(token_counts.histogram(docs, bpe.default_path()))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule",
    )


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Counts, the longest run, and digests of the runs and of the collapsed text."""
    found = periodic_runs.periodic_runs(docs)
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    )
    best = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    start, period = -F.col("best.col2"), -F.col("best.col3")
    length = F.col("best.length")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def repairs(conversations: DataFrame) -> DataFrame:
    """Repairs of damaged conversations, for all original ids."""
    rows = conversation_repair.placed(conversation_repair.damaged(conversations))
    found = conversation_repair.audits(rows, conversation_repair.edits(rows))
    found = found.select(F.struct(*found.columns).alias("found"))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found.conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(f"found.{name}", F.lit(0).cast("long")).alias(name) for name in counts],
        F.coalesce("found.audit", F.lit("")).alias("audit"),
        F.coalesce("found.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extract": op8_html_extract,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_lm_score": op10_lm_score,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_simhash": op12_simhash,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB counterparts of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op3_decontaminate": oracle.DECONTAMINATE,
    "op4_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op9_jaccard_join": oracle.JACCARD_JOIN,
}
