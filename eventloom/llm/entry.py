"""The queries of this folder and their DuckDB equivalents."""

from __future__ import annotations

from eventloom.llm import bpe, chroma, collocations, knn_quality, licenses, line_rules, lm, minmax, mixing, pii, substring, unigram, whitening


def queries() -> dict:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_lm_scoring": lm.op2_lm_scoring,
        "op3_knn_quality": knn_quality.op3_knn_quality,
        "op4_chroma_alignment": chroma.op4_chroma_alignment,
        "op5_minmax_near_dedup": minmax.op5_minmax_near_dedup,
        "op6_personal_data": pii.op6_personal_data,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_token_counts": unigram.op8_token_counts,
        "op9_quality_rules": line_rules.op9_quality_rules,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_collocations": collocations.op11_collocations,
        "op12_license_scans": licenses.op12_license_scans,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_lm_scoring": lm.ORACLE, "op9_quality_rules": line_rules.ORACLE, "op10_mix_sources": mixing.ORACLE, "op11_collocations": collocations.ORACLE}
