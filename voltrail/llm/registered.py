"""The queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from registry.inputs import Query
from voltrail.llm import (
    chat, decontaminate, licenses, line_dedup, lm_score, manifest, near_dedup, packing, pii, prefix_trie, quality,
    vectors, warc,
)
from voltrail.llm.common import given


def on(table: str, op):
    return lambda spark, sf_dir: op(given(spark, sf_dir, table))


def with_table(name: str, op):
    return lambda spark, sf_dir: op(given(spark, sf_dir, "documents"), given(spark, sf_dir, name))


QUERIES = {
    "op1_warc": Query(on("pages", warc.warc_round_trip), warc.SQL),
    "op2_pii": Query(on("documents", pii.personal_data_digests)),
    "op3_lm_score": Query(on("documents", lm_score.score_texts)),
    "op4_line_dedup": Query(on("documents", line_dedup.line_digests), line_dedup.SQL),
    "op5_quality": Query(with_table("labels", quality.judge_quality)),
    "op6_near_dedup": Query(on("documents", lambda docs: near_dedup.near_duplicates(docs, words=2))),
    "op7_licenses": Query(on("documents", licenses.scan_licenses), licenses.SQL),
    "op8_nearest": Query(on("embeddings", vectors.nearest)),
    "op9_decontaminate": Query(with_table("benchmark", decontaminate.find_contamination)),
    "op10_packing": Query(on("documents", packing.pack_documents)),
    "op11_chat": Query(on("conversations", chat.chat_digests), chat.SQL),
    "op12_prefix_trie": Query(on("conversations", prefix_trie.prefix_trie), prefix_trie.SQL),
    "op13_manifest": Query(on("documents", manifest.verify_manifest), manifest.SQL),
    "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
