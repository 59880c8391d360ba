"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyspark.llm import conversation_repair, decontamination, hard_negatives, html_text, licenses, mixing, pii, quality_fm, quality_rules, secrets, simhash, suffix_dedup, toxicity_crf


def queries() -> dict:
    return {
        "op1_html": html_text.op1_html,
        "op2_licenses": licenses.op2_licenses,
        "op3_toxicity_crf": toxicity_crf.op3_toxicity_crf,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_simhash": simhash.op6_simhash,
        "op7_pii_boosting": pii.op7_pii_boosting,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_quality_fm": quality_fm.op9_quality_fm,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_secrets": secrets.op13_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.SQL, "op5_mixing": mixing.SQL, "op10_quality_rules": quality_rules.SQL}
