"""Corpus pipeline: the stages of a training-data build over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``; the last one packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from divspark.llm.common import Workspace, read
from divspark.llm.op1_jaccard_join import keep_one
from divspark.llm.op2_best_fit_packing import pack
from divspark.llm.op5_language_id import keep_identified
from divspark.llm.op6_exact_dedup import keep_first
from divspark.llm.op10_decontamination import keep_clean

#: The stages fit a model and solve a packing: not expressible in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts without a language (null, or no letter) go."""
    return keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one row of each group of equal texts stays."""
    return keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of texts linked by five-word shingles at a similarity of 0.8 or
    more, the row with the smallest id stays."""
    return keep_one(docs, n=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a passage of ``benchmark`` go."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"), short_items=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the remaining documents in as few sequences as can be."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.store(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
