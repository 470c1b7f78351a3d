"""One query per operator, over its whole table."""

from __future__ import annotations

import corpus_pipeline
from datadict.llm import (
    conversations,
    fingerprints,
    html_extract,
    licenses,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    packing,
    quality,
    simhash,
    substring,
    token_counts,
)
from datadict.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op8_quality_rules", quality.sql())
def op8_quality_rules(spark, sf_dir):
    return quality.verdict_rows(table(spark, sf_dir, "documents"))


@query("op3_line_dedup", line_dedup.sql())
def op3_line_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.line_dedup(documents, counts=("n_lines", "n_dropped"))


@query("op9_mixing", mixing.sql())
def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"))


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark, sf_dir):
    rows = ngram_join.joined(table(spark, sf_dir, "documents"), ngram_join.Bound(words=3, percent=90))
    return rows.select("doc_id", rows["n"].alias("n_shingles"), "component_id")


@query("op5_order_minhash")
def op5_order_minhash(spark, sf_dir):
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query("op1_page_text")
def op1_page_text(spark, sf_dir):
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op7_repeated_passages")
def op7_repeated_passages(spark, sf_dir):
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_edited_token_counts")
def op10_edited_token_counts(spark, sf_dir):
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    return licenses.license_scan(licenses.with_paths(table(spark, sf_dir, "documents")))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


@query("op12_merkle_manifest", merkle.sql())
def op12_merkle_manifest(spark, sf_dir):
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


@query("op11_simhash")
def op11_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
