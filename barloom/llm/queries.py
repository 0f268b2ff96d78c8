"""The registered queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_html_extraction": "html_extraction",
    "op2_secret_scan": "secret_scan",
    "op3_source_mix": "source_mix",
    "op4_token_counts": "token_counts",
    "op5_language_id": "language_id",
    "op6_minhash_near_dedup": "near_dedup",
    "op7_quality_rules": "quality_rules",
    "op8_benchmark_decontamination": "decontamination",
    "op9_personal_data": "personal_data",
    "op10_quality_classifier": "quality_classifier",
    "op11_toxicity": "toxicity",
    "op12_hard_negatives": "hard_negatives",
    "op13_spelling_variants": "spelling_variants",
}

QUERIES = {name: import_module(f"{__package__}.{module}").query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE_SQL for name, m in _MODULES.items() if hasattr(module := import_module(f"{__package__}.{m}"), "ORACLE_SQL")}
