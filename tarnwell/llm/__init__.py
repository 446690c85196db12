"""Corpus operators for training data. Nothing else in the library imports this package."""

from __future__ import annotations

from tarnwell.llm import chat, decontamination, divergence, filter_audit, jaccard_join, licenses, line_dedup, mixing, quality_rules, resampling, secrets, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_importance_resampling": resampling.op1_importance_resampling,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_mixing": mixing.op7_mixing,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_license_scan": licenses.op12_license_scan,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_formatting": chat.SQL,
        "op6_decontamination": decontamination.SQL,
        "op7_mixing": mixing.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_license_scan": licenses.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
