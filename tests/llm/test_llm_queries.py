import pytest

import corpus_pipeline
from fareline.llm import decontaminate, jaccard_join, pii, quality_rules, queries

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, "
    "items_sha256 string, contaminated boolean",
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
    "kept_sha256 string",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_token_counts": "length bigint, docs bigint",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op9_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "train_tokens bigint, base_score double, score double",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, "
    "period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    types = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        label, kind = column.split(" ")
        assert types[label] == kind
    tables = {"op5_url_filter": "pages", "op8_html_extract": "pages"}
    if name == "op13_conversation_repair":
        source = spark.read.parquet(f"{FOLDER}/conversations.parquet")
        assert found.count() == source.select("conv_id").distinct().count()
    elif name != "op6_token_counts":
        source = spark.read.parquet(f"{FOLDER}/{tables.get(name, 'documents')}.parquet")
        assert found.count() == source.count()
    else:
        assert found.count() > 0


def test_pipeline_stages(spark):
    """Each stage's decisions agree with its operator on the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = quality_rules.stage(spark, docs, FOLDER).cache()
    assert kept.columns == docs.columns
    rules = quality_rules.learn_rules(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    judged = quality_rules.judged(docs, rules).where("kept").select("row.doc_id")
    assert {r[0] for r in judged.collect()} == {r.doc_id for r in kept.collect()}
    single = jaccard_join.stage(spark, kept, FOLDER).cache()
    groups = jaccard_join.similar(kept, size=5, percent=80).where("doc_id = component_id").select("doc_id")
    assert {r[0] for r in groups.collect()} == {r.doc_id for r in single.collect()}
    clean = decontaminate.stage(spark, single, FOLDER).cache()
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    free = decontaminate.contamination(single, benchmark).where("n_hit = 0").select("doc_id")
    assert {r[0] for r in free.collect()} == {r.doc_id for r in clean.collect()}
    masked = pii.stage(spark, clean, FOLDER).cache()
    assert masked.columns == docs.columns and masked.count() == clean.count()
    assert masked.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").isEmpty()
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in masked.collect()}
