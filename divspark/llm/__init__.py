"""Operators of a training-data pipeline (deduplication, packing, extraction,
archives, language identification, scoring and decontamination).

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
