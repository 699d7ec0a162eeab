"""Stand-in inputs derived from the driver's tables (see FIXTURES.md).

Each has a Spark form and the same derivation as SQL text (a CTE body), so a
query and its oracle start from identical rows.

* ``round0``: documents joined to embeddings on ``doc_id = vec_id``; run key
  ``run = lang``, ``label`` from embeddings, ``seed = source``.
* ``seeded``: every document as such a row, ``label = doc_id % 10`` (queries that
  need no embedding).
* ``labelled``: documents joined to labels; ``run = lang``, ``label = quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.sources.tables import read_table

RUN = ["run"]


def round0(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("run"), "text", F.col("source").alias("seed"))
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "label", "embedding")
    return d.join(e, "doc_id")


ROUND0_SQL = ("SELECT d.doc_id, d.lang AS run, d.text, d.source AS seed, e.label, e.embedding "
              "FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a round-0 row: ``run = lang``, ``seed = source``, ``label = doc_id % 10``."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("run"), "text", F.col("source").alias("seed"),
        F.pmod("doc_id", F.lit(10)).cast("int").alias("label"))


SEEDED_SQL = ("SELECT doc_id, lang AS run, text, source AS seed, CAST(doc_id % 10 AS INTEGER) AS label FROM documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("run"), "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id")


LABELLED_SQL = ("SELECT d.doc_id, d.lang AS run, d.text, l.quality AS label "
                "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
