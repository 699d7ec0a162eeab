"""Outlier queries (G-1, G-4, K-2 .. K-7) on the ``round0`` stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from divspark.operators import outliers as O
from divspark.plans import sqlbits as Q
from divspark.plans.registry import register
from divspark.plans.standins import ROUND0_SQL, RUN, SEEDED_SQL, round0, seeded

_DIST_SQL = f"""
r0 AS ({ROUND0_SQL}),
ex AS (SELECT run, label, doc_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM r0),
cent AS (SELECT run, label, pos, avg(CAST(v AS DOUBLE)) AS m FROM ex GROUP BY run, label, pos),
dist AS (
  SELECT ex.run, ex.label, ex.doc_id,
         sqrt(sum((CAST(v AS DOUBLE) - m) * (CAST(v AS DOUBLE) - m))) AS distance
  FROM ex JOIN cent ON ex.run = cent.run AND ex.label = cent.label AND ex.pos = cent.pos
  GROUP BY ex.run, ex.label, ex.doc_id),
outl AS (SELECT dist.*, r0.text, r0.seed FROM dist JOIN r0 ON dist.doc_id = r0.doc_id),
nseed AS (SELECT run, label, count(DISTINCT seed) AS n FROM r0 GROUP BY run, label)"""


def _outliers(spark, sf):
    r0 = round0(spark, sf)
    return r0, O.centroid_distance(r0, RUN)


@register("centroid_distance", f"""
WITH {_DIST_SQL}
SELECT run, label, doc_id, round(distance, 9) AS distance FROM outl""")
def centroid_distance(spark, sf):
    """K-2: distance of every round-0 row to its (run, label) centroid."""
    _, out = _outliers(spark, sf)
    return out.select("run", "label", "doc_id", F.round("distance", 9).alias("distance"))


@register("label_centroids", f"""
WITH {_DIST_SQL}
SELECT run, label, pos AS dim, round(m, 9) AS mean FROM cent""")
def label_centroids(spark, sf):
    """G-4: mean embedding per (run, label), one row per dimension."""
    c = O.centroids(round0(spark, sf), RUN)
    return (c.select("run", "label", F.posexplode("centroid").alias("dim", "mean"))
            .select("run", "label", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("mean", 9).alias("mean")))


@register("label_seed_sets", f"""
WITH r0 AS ({SEEDED_SQL})
SELECT run, label, seed, count(*) OVER (PARTITION BY run, label) AS n_seeds
FROM (SELECT DISTINCT run, label, seed FROM r0 WHERE seed IS NOT NULL)""")
def label_seed_sets(spark, sf):
    """G-1: distinct seeds per (run, label), long form, with the set size."""
    r0 = seeded(spark, sf)
    sets = O.label_seed_sets(r0, RUN)
    counts = O.label_seed_counts(r0, RUN)
    return sets.join(counts, ["run", "label"]).select("run", "label", "seed", "n_seeds")


@register("chaining_seeds", f"""
WITH {_DIST_SQL},
ranked AS (
  SELECT outl.*, n, row_number() OVER (PARTITION BY outl.run, outl.label
                                       ORDER BY distance DESC, text, doc_id) AS rank
  FROM outl JOIN nseed ON outl.run = nseed.run AND outl.label = nseed.label)
SELECT run, label, CAST(rank AS INTEGER) AS rank, doc_id, round(distance, 9) AS distance, text
FROM ranked WHERE rank <= n""")
def chaining_seeds(spark, sf):
    """K-3: the N farthest round-0 texts per (run, label), N = distinct seeds of the label."""
    r0, out = _outliers(spark, sf)
    s = O.chaining_seeds(out, r0, RUN, tie=["doc_id"])
    return s.select("run", "label", "rank", "doc_id", F.round("distance", 9).alias("distance"), "text")


@register("chaining_seeds_random", f"""
WITH {_DIST_SQL},
ranked AS (
  SELECT outl.*, n, row_number() OVER (PARTITION BY outl.run, outl.label
                                       ORDER BY {Q.order_key('text', 'chaining:7', 'outl.run', 'outl.label')}, text, doc_id) AS rank
  FROM outl JOIN nseed ON outl.run = nseed.run AND outl.label = nseed.label)
SELECT run, label, CAST(rank AS INTEGER) AS rank, doc_id, text
FROM ranked WHERE rank <= n""")
def chaining_seeds_random(spark, sf):
    """K-4: N texts per (run, label) in salted-hash order (random ablation)."""
    r0, out = _outliers(spark, sf)
    s = O.chaining_seeds(out, r0, RUN, random=True, salt="7", tie=["doc_id"])
    return s.select("run", "label", "rank", "doc_id", "text")


_HINT_BASE = f"""
WITH {_DIST_SQL},
o AS (SELECT DISTINCT run, label, text, distance FROM outl),
r AS (SELECT run, text, seed, count(*) AS copies
      FROM (SELECT DISTINCT run, label, text, seed FROM r0) GROUP BY run, text, seed),
merged AS (SELECT o.run, o.label, o.text, o.distance, r.seed, r.copies
           FROM o JOIN r ON o.run = r.run AND o.text = r.text)"""


@register("hint_candidates", f"""{_HINT_BASE}
SELECT run, label, md5(text) AS text_md5, round(distance, 9) AS distance, seed, copies FROM merged""")
def hint_candidates(spark, sf):
    """K-5: outliers joined to round 0 on text, distinct before projection
    (multiplicity of a (text, seed) across labels kept as ``copies``)."""
    r0, out = _outliers(spark, sf)
    m = O.attach_seeds(out, r0, RUN)
    return m.select("run", "label", F.md5("text").alias("text_md5"),
                    F.round("distance", 9).alias("distance"), "seed", "copies")


@register("hints_top3", f"""{_HINT_BASE},
rep AS (SELECT merged.*, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS rep FROM merged),
ranked AS (SELECT rep.*, row_number() OVER (PARTITION BY run, seed
                                            ORDER BY distance DESC, text, label, rep) AS hint_rank
           FROM rep)
SELECT run, seed, CAST(hint_rank AS INTEGER) AS hint_rank, md5(text) AS hint_md5,
       label AS hint_label, round(distance, 9) AS hint_distance
FROM ranked WHERE hint_rank <= 3""")
def hints_top3(spark, sf):
    """K-6: the three farthest hint texts per seed (label ignored)."""
    r0, out = _outliers(spark, sf)
    h = O.hints_per_seed(out, r0, RUN, 3)
    return h.select("run", "seed", "hint_rank", F.md5("hint").alias("hint_md5"), "hint_label",
                    F.round("hint_distance", 9).alias("hint_distance"))


@register("hints_random", f"""{_HINT_BASE},
rep AS (SELECT merged.*, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS rep FROM merged),
ranked AS (SELECT rep.*, row_number() OVER (PARTITION BY run, seed
                                            ORDER BY {Q.order_key('text', 'hints:7', 'run', 'label')}, text, label, distance, rep) AS hint_rank
           FROM rep)
SELECT run, seed, CAST(hint_rank AS INTEGER) AS hint_rank, md5(text) AS hint_md5, label AS hint_label
FROM ranked WHERE hint_rank <= 3""")
def hints_random(spark, sf):
    """K-7: three hint texts per seed in salted-hash order (random ablation)."""
    r0, out = _outliers(spark, sf)
    h = O.hints_per_seed(out, r0, RUN, 3, random=True, salt="7")
    return h.select("run", "seed", "hint_rank", F.md5("hint").alias("hint_md5"), "hint_label")


def _hint_prompt_sql():
    from divspark.functions import prompts as P
    loc = P.HINT_TEMPLATE_LOCAL.split("{}")
    gpt = P.HINT_TEMPLATE_GPT.split("{}")
    return f"""{_HINT_BASE},
rep AS (SELECT merged.*, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS rep FROM merged),
ranked AS (SELECT rep.*, row_number() OVER (PARTITION BY run, seed
                                            ORDER BY distance DESC, text, label, rep) AS hint_rank FROM rep),
hl AS (SELECT run, seed, string_agg('"' || text || '".', chr(10) ORDER BY hint_rank) AS block
       FROM ranked WHERE hint_rank <= 3 GROUP BY run, seed)
SELECT run, seed, {Q.lit(loc[0])} || seed || {Q.lit(loc[1])} || block || {Q.lit(loc[2])} AS prompt_local,
       {Q.lit(gpt[0])} || seed || {Q.lit(gpt[1])} || block || {Q.lit(gpt[2])} AS prompt_gpt
FROM hl"""


@register("prompts_hints", _hint_prompt_sql())
def prompts_hints(spark, sf):
    """B-3 / B-4: hint prompts (local-model and GPT templates) with each seed's
    three farthest hints."""
    from divspark.functions import prompts as P

    r0, out = _outliers(spark, sf)
    h = O.hint_lists(O.hints_per_seed(out, r0, RUN, 3), RUN)
    return h.select("run", "seed", P.hint_prompt("seed", "hints").alias("prompt_local"),
                    P.hint_prompt("seed", "hints", P.HINT_TEMPLATE_GPT).alias("prompt_gpt"))
