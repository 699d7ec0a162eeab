"""Text core and sampling queries on ``documents`` (C-1 .. C-8, F-1 .. F-11, S-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from divspark.functions import text as T
from divspark.operators import filters as FL
from divspark.operators import sampling as S
from divspark.operators.joins import join_small
from divspark.operators.ranking import rank_within
from divspark.plans import sqlbits as Q
from divspark.plans.registry import register
from divspark.plans.standins import LABELLED_SQL, SEEDED_SQL, labelled, seeded
from divspark.sources.tables import read_table


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("clean_text", f"""
SELECT doc_id, {Q.clean('text')} AS text_clean,
       {Q.clean('text', do_strip=False, depunct=False, nullify=False)} AS text_light,
       {Q.clean('text', depunct=False, nullify=False)} AS text_reclean
FROM documents""")
def clean_text(spark, sf):
    """C-1 .. C-4 (lower, strip, dequote, depunctuate), C-6's light seed clean
    (lower, dequote) and K-8's re-clean before hints (lower, strip, dequote)."""
    d = _docs(spark, sf)
    return d.select("doc_id", T.clean_text("text").alias("text_clean"),
                    T.clean_text("text", strip=False, remove_punctuation=False,
                                 nullify_empty=False).alias("text_light"),
                    T.clean_text("text", remove_punctuation=False, nullify_empty=False).alias("text_reclean"))


@register("clean_distinct", f"""
SELECT DISTINCT lang, text FROM (SELECT lang, {Q.clean('text')} AS text FROM documents)
WHERE text IS NOT NULL""")
def clean_distinct(spark, sf):
    """C-5: clean, then distinct rows, then drop nulls (F-4, F-6)."""
    d = _docs(spark, sf).select("lang", T.clean_text("text").alias("text"))
    return FL.drop_nulls(FL.distinct_rows(d))


@register("stopword_tokens", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_words, array_to_string(toks, ' ') AS words
FROM (SELECT doc_id, {Q.no_stop_tokens('text')} AS toks FROM documents)""")
def stopword_tokens(spark, sf):
    """C-7 ``cleantext``: whitespace split, stop words removed (case-sensitive)."""
    d = _docs(spark, sf).select("doc_id", T.remove_stop_words("text").alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_words"), T.join_words("toks").alias("words"))


@register("word_tokens", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {Q.word_tokens('text')} AS toks FROM documents)""")
def word_tokens(spark, sf):
    """C-8: CountVectorizer's analyzer (lower case, 2+ word characters)."""
    d = _docs(spark, sf).select("doc_id", T.word_tokens("text").alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"), T.join_words("toks").alias("tokens"))


@register("stratified_sample", f"""
SELECT source, lang, CAST(rank AS INTEGER) AS rank, doc_id FROM (
  SELECT source, lang, doc_id, row_number() OVER (
    PARTITION BY source, lang ORDER BY {Q.order_key('text', 'seed', 'source', 'lang')}, text, doc_id) AS rank
  FROM documents) WHERE rank <= 6""")
def stratified_sample(spark, sf):
    """F-1: six rows per label (lang) in every run (source)."""
    s = S.stratified_sample(_docs(spark, sf), ["source"], 6, label="lang", salt="seed", tie=["doc_id"])
    return s.select("source", "lang", "rank", "doc_id")


@register("sample_fraction", f"""
SELECT lang, rank, doc_id FROM (
  SELECT lang, doc_id,
         row_number() OVER (PARTITION BY lang ORDER BY {Q.order_key('text', 'frac', 'lang')}, text, doc_id) AS rank,
         count(*) OVER (PARTITION BY lang) AS n
  FROM documents)
WHERE rank <= CAST(round_even(n * 0.1, 0) AS BIGINT)""")
def sample_fraction(spark, sf):
    """F-3: exact ``round(0.1 * n)`` rows per run (lang)."""
    s = S.sample_fraction(_docs(spark, sf), ["lang"], 0.1, salt="frac", tie=["doc_id"])
    return s.select("lang", "rank", "doc_id")


@register("sample_large", f"""
SELECT half, doc_id FROM (
  SELECT doc_id, doc_id % 2 AS half,
         row_number() OVER (PARTITION BY doc_id % 2 ORDER BY {Q.order_key('text', 'large', 'doc_id % 2')}, text, doc_id) AS rank,
         count(*) OVER (PARTITION BY doc_id % 2) AS n
  FROM documents)
WHERE rank <= CAST(round_even(n * 0.6, 0) AS BIGINT)""")
def sample_large(spark, sf):
    """F-3 for a large sample: ``round(0.6 * n)`` rows of each of two runs, cut at the order
    hash of the last row without a sort (past the top-k threshold)."""
    d = _docs(spark, sf).withColumn("half", F.pmod("doc_id", F.lit(2)))
    return S.sample_fraction(d, ["half"], 0.6, salt="large", tie=["doc_id"], rank_col=None).select("half", "doc_id")


@register("shuffle_positions", f"""
SELECT doc_id, row_number() OVER (ORDER BY {Q.order_key('text', 'shuf')}, text, doc_id) AS position
FROM documents""")
def shuffle_positions(spark, sf):
    """F-2: position of every row in the repeatable shuffle (exact global rank,
    computed without a single-task sort)."""
    d = _docs(spark, sf)
    order = [T.order_key("text", "shuf").asc(), F.col("text").asc(), F.col("doc_id").asc()]
    return rank_within(d.select("doc_id", "text"), [], order, rank_col="position").select("doc_id", "position")


@register("train_test_split", f"""
WITH reps AS (SELECT doc_id, text, r.rep, CAST(r.rep AS VARCHAR) || ':' || text AS rt
              FROM documents, (SELECT unnest(range(0, 10)) AS rep) r),
ranked AS (SELECT rep, doc_id, row_number() OVER (PARTITION BY rep ORDER BY {Q.order_key('rt', 'split')}, rt, doc_id) AS rn,
                  count(*) OVER (PARTITION BY rep) AS n FROM reps)
SELECT CAST(rep AS INTEGER) AS rep, doc_id, rn <= ceil(n * 0.01) AS is_test FROM ranked""")
def train_test_split(spark, sf):
    """F-11: ten repeated 1% test splits (scikit-learn sizes), both sides."""
    s = S.train_test_split(_docs(spark, sf).select("doc_id", "text"), [], 0.01, 10,
                           salt="split", tie=["doc_id"])
    return s.select("rep", "doc_id", "is_test")


_LANG_IDS = {"de": 0, "en": 1, "es": 2, "fr": 3}


@register("label_ids", """
SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS label
FROM documents""")
def label_ids(spark, sf):
    """F-9: label name to id through a fixed map (strict: unknown names fail)."""
    return FL.map_labels(_docs(spark, sf), _LANG_IDS, "lang").select("doc_id", "label")


@register("one_vs_rest", f"""
WITH l AS ({LABELLED_SQL}), t AS (SELECT DISTINCT run, label AS target FROM l)
SELECT l.run, t.target, l.doc_id, CASE WHEN l.label = t.target THEN 1 ELSE 0 END AS y
FROM l JOIN t ON l.run = t.run""")
def one_vs_rest(spark, sf):
    """F-10: every labelled row relabelled 0/1 against each label of its run."""
    lab = labelled(spark, sf)
    targets = lab.select("run", F.col("label").alias("target")).distinct()
    rows = join_small(lab, targets, ["run"])
    return FL.one_vs_rest(rows, "target").select("run", "target", "doc_id", "y")


@register("seed_table", f"""
SELECT DISTINCT run, {Q.clean('seed')} AS text, label FROM ({SEEDED_SQL})""")
def seed_table(spark, sf):
    """S-6 + C-6: seed column of round 0 to a (text, label) seed table, cleaned."""
    seeds = FL.normalise_seeds(seeded(spark, sf), ["run"])
    return seeds.select("run", T.clean_text("text").alias("text"), "label").distinct()
