"""Queries of the numbered operators and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ("op1_jaccard_join", "op2_best_fit_packing", "op3_html_extraction", "op4_warc_archive",
           "op5_language_id", "op6_exact_dedup", "op7_lm_scoring", "op8_license_scan",
           "op9_token_counts", "op10_decontamination", "op11_spelling_variants",
           "op12_embedding_whitening", "op13_toxicity")


def _modules():
    return [(m, importlib.import_module(f"divspark.llm.{m}")) for m in MODULES]


def queries() -> dict:
    return {name: getattr(m, name) for name, m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for name, m in _modules() if hasattr(m, "ORACLE_SQL")}
