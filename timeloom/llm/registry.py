"""The opN_ queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from timeloom.llm import (
    decontam, filter_audit, html_extract, language_id, license_scan, mixing, packing, phrases, quality_classifier, quality_rules, simhash, token_output, toxicity,
)

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_html_extraction": html_extract.op2,
    "op3_decontamination": decontam.op3,
    "op4_license_scan": license_scan.op4,
    "op5_simhash": simhash.op5,
    "op6_token_output": token_output.op6,
    "op7_toxicity": toxicity.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_quality_classifier": quality_classifier.op9,
    "op10_mixing": mixing.op10,
    "op11_phrase_mining": phrases.op11,
    "op12_packing": packing.op12,
    "op13_filter_audit": filter_audit.op13,
}
ORACLES = {
    "op3_decontamination": decontam.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op11_phrase_mining": phrases.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
