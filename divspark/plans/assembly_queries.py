"""Assembly queries (A-1 .. A-5) on ``documents``.

Stand-in: run ``= lang``, label ``= source``; each document plays one role by
``doc_id % 3`` (0 round 0, 1 method round, 2 seeds; every row is used), and a
method-round row belongs to one of the seven methods by ``(doc_id / 3) % 7``.
Texts are cleaned first; the table repeats some texts, so the dedup has work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from divspark.functions.text import clean_text
from divspark.operators.assembly import METHODS, assemble
from divspark.plans import sqlbits as Q
from divspark.plans.registry import register
from divspark.sources.tables import read_table

_METHODS = METHODS


def _inputs(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("run"), F.col("source").alias("label"),
        clean_text("text", remove_quotes=False).alias("text"))
    role = F.pmod(F.col("doc_id"), F.lit(3))
    r0 = d.where(role == 0).withColumn("seed", F.concat(F.lit("seed-"), F.col("label")))
    mr = (d.where(role == 1).withColumn("seed", F.concat(F.lit("seed-"), F.col("label")))
          .withColumn("method", F.element_at(F.array(*[F.lit(m) for m in _METHODS]),
                                             (F.pmod(F.floor(F.col("doc_id") / 3), F.lit(len(_METHODS))) + 1)
                                             .cast("int"))))
    sd = d.where(role == 2)
    return r0, mr, sd


def _sql(scope):
    filt_m = ("AND (method = 'prompt' OR NOT contains(text, 'paraphra'))" if scope == "method" else "")
    filt_a = ("AND NOT contains(text, 'paraphra')" if scope == "all" else "")
    return f"""
WITH d AS (SELECT doc_id, lang AS run, source AS label, {Q.clean('text', dequote=False)} AS text FROM documents),
r0 AS (SELECT run, label, text, 'seed-' || label AS seed FROM d WHERE doc_id % 3 = 0),
mr AS (SELECT run, label, text, 'seed-' || label AS seed,
              {list(_METHODS)}[CAST((doc_id // 3) % {len(_METHODS)} AS INTEGER) + 1] AS method
       FROM d WHERE doc_id % 3 = 1),
sd AS (SELECT run, text, label FROM d WHERE doc_id % 3 = 2),
m AS (SELECT DISTINCT run, method FROM mr WHERE text IS NOT NULL),
u AS (
  SELECT r0.run, m.method, r0.label, r0.text, r0.seed, 0 AS priority FROM r0 JOIN m ON r0.run = m.run
    WHERE r0.text IS NOT NULL AND r0.label IS NOT NULL AND r0.seed IS NOT NULL
  UNION ALL
  SELECT run, method, label, text, seed, 1 FROM mr WHERE text IS NOT NULL {filt_m}
  UNION ALL
  SELECT sd.run, m.method, sd.label, sd.text, NULL, 2 FROM sd JOIN m ON sd.run = m.run
    WHERE sd.text IS NOT NULL AND sd.label IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY run, method, text
                                   ORDER BY priority, {Q.order_key('text', 'asm', 'run', 'label', 'seed')}) AS rn FROM u)
SELECT run, method, translate(text, '"', '') AS text, label FROM w WHERE rn = 1 {filt_a}"""


@register("assemble", _sql("method"))
def assemble_method_scope(spark, sf):
    """A-1 .. A-5: round 0 + method round + seeds per (run, method), first wins,
    refusal filter on the method round (not on the plain method), dequote."""
    r0, mr, sd = _inputs(spark, sf)
    return assemble(r0, mr, sd, ["run"], salt="asm").select("run", "method", "text", "label")


@register("assemble_filter_all", _sql("all"))
def assemble_all_scope(spark, sf):
    """A-3 variant: the refusal filter applied to the deduplicated union."""
    r0, mr, sd = _inputs(spark, sf)
    return assemble(r0, mr, sd, ["run"], filter_scope="all", salt="asm").select("run", "method", "text", "label")
