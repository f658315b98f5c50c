"""A training corpus from raw documents: rules, near copies, benchmark texts, personal data, tokens.

``run`` applies the stages in order. Each stage reads what the one before it wrote to the shared
folder, so a lost executor costs a re-read. Once a stage is written, its own tables and its input
are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fareline.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from fareline.session import new_path, remove, scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: Learned rules, classifiers and BPE are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded documents that passed all stages: id, token count and digests."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
