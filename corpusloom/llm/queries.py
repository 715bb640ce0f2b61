"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe_stream, chat, decontamination, license_scan, line_dedup, packing, phrases, quality, simhash, token_store, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_chat_format": chat.op4_chat_format,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_phrase_collocations": phrases.op12_phrase_collocations,
        "op13_bpe_stream": bpe_stream.op13_bpe_stream,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in (chat, license_scan, line_dedup, phrases, quality, url_filter):
        found |= module.SQL
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
