"""The training-data queries by name, and their SQL oracles."""

from __future__ import annotations

from gridloom.llm.queries import bases, op01, op02, op03, op04, op05, op06, op07, op08, op09, op10

QUERIES = {
    "op1_minhash_near_dedup": op01.op1_minhash_near_dedup,
    "op2_secret_scans": op02.op2_secret_scans,
    "op3_lm_scoring": op03.op3_lm_scoring,
    "op4_bpe_encoding": op04.op4_bpe_encoding,
    "op5_best_fit_packing": op05.op5_best_fit_packing,
    "op6_quality_rules": op06.op6_quality_rules,
    "op7_url_filters": op07.op7_url_filters,
    "op8_document_fingerprints": op08.op8_document_fingerprints,
    "op9_chat_formatting": op09.op9_chat_formatting,
    "op10_quality_classifier": op10.op10_quality_classifier,
    "secret_scans_base": bases.secret_scans_base,
    "fingerprint_edits": bases.fingerprint_edits,
}

ORACLES = bases.ORACLES | {
    "op1_minhash_near_dedup": op01.ORACLE,
    "op6_quality_rules": op06.ORACLE,
    "op7_url_filters": op07.ORACLE,
    "op9_chat_formatting": op09.ORACLE,
}
