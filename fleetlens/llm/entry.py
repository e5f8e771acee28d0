"""The queries of this package, and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, importance, license_scan, line_rules, mixing, near_dedup, ngram_lm, personal_data, quality_model, token_files, vector_codes, vector_search


def queries() -> dict:
    found = (
        quality_model.op1_quality_classifier,
        license_scan.op2_license_scan,
        near_dedup.op3_near_dedup,
        vector_search.op4_nearest_vectors,
        bpe.op5_bpe,
        line_rules.op6_quality_rules,
        ngram_lm.op7_backoff_scores,
        chat_format.op8_chat_format,
        token_files.op9_token_files,
        mixing.op10_mix_sources,
        importance.op11_importance_resampling,
        vector_codes.op12_vector_codes,
        personal_data.op13_personal_data,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan.oracle(),
        "op3_near_dedup": near_dedup.ORACLE_SQL,
        "op8_chat_format": chat_format.ORACLE_SQL,
        "op11_importance_resampling": importance.oracle(),
        "op12_vector_codes": vector_codes.oracle(),
        "op13_personal_data": personal_data.oracle(),
    }
