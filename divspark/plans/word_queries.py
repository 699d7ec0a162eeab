"""Word statistics and taboo-word queries (G-2, G-3, T-1 .. T-9).

Word scores for the SQL-checked taboo queries are the word's count inside the
label.  The optimum of an SVM has no SQL form: its queries carry a certificate, and
tests compare them with a brute-force dual solver.  Entity spans are the ``benchmark``
texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from divspark.functions.text import DIGIT_CLASS, whitespace_tokens
from divspark.operators import linear
from divspark.operators import words as W
from divspark.plans import sqlbits as Q
from divspark.plans.registry import register
from divspark.plans.standins import LABELLED_SQL, labelled
from divspark.sources.tables import read_table

RUN = ["run"]


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("run"), "text")


_TOKS = f"regexp_extract_all(lower(array_to_string({Q.no_stop_tokens('text')}, ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@register("count_matrix", f"""
SELECT run, doc_id, word, count(*) AS count FROM (
  SELECT lang AS run, doc_id, unnest({_TOKS}) AS word FROM documents WHERE text IS NOT NULL)
GROUP BY run, doc_id, word""")
def count_matrix(spark, sf):
    """G-2: sparse count matrix of stop-word-cleaned documents, long form."""
    return W.count_matrix(_docs(spark, sf), RUN).select("run", "doc_id", "word", "count")


@register("word_freq", f"""
SELECT run, word, count(*) AS freq FROM (
  SELECT lang AS run, unnest({_TOKS}) AS word FROM documents WHERE text IS NOT NULL)
GROUP BY run, word""")
def word_freq(spark, sf):
    """G-3: corpus frequency per run and word."""
    return W.token_frequencies(_docs(spark, sf), RUN).select("run", "word", "freq")


def _label_scores(spark, sf):
    counts = W.label_word_counts(labelled(spark, sf), RUN)
    freq = W.word_frequencies(counts, RUN)
    scores = counts.withColumnRenamed("count", "score")
    ents = W.entity_words(read_table(spark, sf, "benchmark").select(F.col("text").alias("span")))
    return W.taboo_candidates(scores, freq, RUN, entities=ents)


_CAND_SQL = f"""
WITH l AS ({LABELLED_SQL}),
toks AS (SELECT run, doc_id, label, unnest({_TOKS}) AS word FROM l WHERE text IS NOT NULL),
freq AS (SELECT run, word, count(*) AS freq FROM toks GROUP BY run, word),
score AS (SELECT run, label, word, count(*) AS score FROM toks GROUP BY run, label, word),
ent AS (SELECT DISTINCT unnest({Q.ws_tokens('lower(text)')}) AS word FROM benchmark),
cand AS (SELECT s.run, s.label, s.word, s.score, f.freq FROM score s JOIN freq f ON s.run = f.run AND s.word = f.word
         WHERE f.freq >= 5 AND NOT regexp_full_match(s.word, '{DIGIT_CLASS}+')
           AND s.word NOT IN (SELECT word FROM ent))"""


@register("taboo_candidates", f"""{_CAND_SQL}
SELECT run, label, word, score, freq FROM cand""")
def taboo_candidates(spark, sf):
    """T-3 .. T-7: scores joined with run frequencies, floor 5, no numeric or entity words."""
    return _label_scores(spark, sf).select("run", "label", "word", "score", "freq")


@register("taboo_words_by_count", f"""{_CAND_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY score DESC, freq DESC, word DESC) AS r FROM cand)
SELECT run, label, string_agg(word, ' ' ORDER BY r DESC) AS words FROM ranked WHERE r <= 3 GROUP BY run, label""")
def taboo_words_by_count(spark, sf):
    """T-8: the top three words per (run, label), listed in ascending score."""
    t = W.top_words(_label_scores(spark, sf), RUN, 3, score="score")
    return t.select("run", "label", F.array_join("words", " ").alias("words"))


@register("taboo_words_random", f"""{_CAND_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY {Q.order_key('word', 'taboo:tabu', 'run', 'label')} DESC, word DESC) AS r
           FROM cand)
SELECT run, label, string_agg(word, ' ' ORDER BY r DESC) AS words FROM ranked WHERE r <= 3 GROUP BY run, label""")
def taboo_words_random(spark, sf):
    """T-9: three candidate words per (run, label) from a salted-hash permutation."""
    t = W.top_words(_label_scores(spark, sf), RUN, 3, random=True, salt="tabu")
    return t.select("run", "label", F.array_join("words", " ").alias("words"))


@register("svm_coefficients")
def svm_coefficients(spark, sf):
    """T-1 / T-2: one-vs-rest linear SVM coefficients per (run, label, word), with the
    objective and the duality gap of their problem."""
    return W.svm_coefficients(labelled(spark, sf), RUN).select(
        "run", "label", "word", "coefficient", "freq", "objective", "gap")


@register("svm_certificates", f"""
WITH l AS ({LABELLED_SQL}),
v AS (SELECT * FROM l WHERE text IS NOT NULL AND label IS NOT NULL),
voc AS (SELECT run, count(DISTINCT word) AS n_words FROM (SELECT run, unnest({_TOKS}) AS word FROM v) GROUP BY run)
SELECT v.run, v.label, max(voc.n_words) AS n_words, TRUE AS certified
FROM v JOIN voc ON v.run = voc.run WHERE v.run IN (SELECT run FROM v GROUP BY run HAVING count(DISTINCT label) > 1)
GROUP BY v.run, v.label""")
def svm_certificates(spark, sf):
    """T-1: every (run, label) problem is solved: its duality gap, which bounds the distance
    of the objective from the optimum, is below the tolerance."""
    c = W.svm_coefficients(labelled(spark, sf), RUN)
    return c.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n_words"),
                                         (F.max("gap") < linear.TOLERANCE).alias("certified"))


@register("taboo_words")
def taboo_words(spark, sf):
    """T-1 .. T-8: the reference's taboo words (SVM coefficients, floor 5,
    numeric and entity words removed, last three)."""
    coef = W.svm_coefficients(labelled(spark, sf), RUN)              # carries the run's word frequencies
    ents = W.entity_words(read_table(spark, sf, "benchmark").select(F.col("text").alias("span")))
    cand = W.taboo_candidates(coef, None, RUN, entities=ents)
    t = W.top_words(cand, RUN, 3)
    return t.select("run", "label", F.array_join("words", " ").alias("words"))


@register("phrase_spans", f"""
WITH b AS (SELECT {Q.ws_tokens('lower(text)')} AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS span FROM b, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
l AS ({LABELLED_SQL}),
t AS (SELECT run, label, ' ' || array_to_string({Q.ws_tokens('lower(text)')}, ' ') || ' ' AS x FROM l WHERE text IS NOT NULL)
SELECT DISTINCT run, label, span FROM t JOIN p ON contains(x, ' ' || span || ' ')""")
def phrase_spans(spark, sf):
    """T-6 / T-7: entity spans of one to three words from a phrase table (the beginnings of
    the benchmark items), found as whole words in each label's texts."""
    w = whitespace_tokens(F.lower("text"))
    begin = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))
    phrases = read_table(spark, sf, "benchmark").select(F.explode(begin).alias("phrase"))
    return W.phrase_spans(labelled(spark, sf), phrases, RUN, text="text")


def _taboo_prompt_sql():
    from divspark.functions import prompts as P
    t = P.TABOO_TEMPLATE.split("{}")
    return f"""{_CAND_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY score DESC, freq DESC, word DESC) AS r FROM cand),
tw AS (SELECT run, label, list(word ORDER BY r DESC) AS w FROM ranked WHERE r <= 3 GROUP BY run, label),
s AS (SELECT DISTINCT run, label, source AS seed FROM l JOIN documents d ON l.doc_id = d.doc_id)
SELECT s.run, s.label, s.seed,
       {Q.lit(t[0])} || s.seed || {Q.lit(t[1])} || tw.w[1] || {Q.lit(t[2])} || tw.w[2] || {Q.lit(t[3])} || tw.w[3]
       || {Q.lit(t[4])} AS prompt
FROM s JOIN tw ON s.run = tw.run AND s.label = tw.label"""


@register("prompts_taboo", _taboo_prompt_sql())
def prompts_taboo(spark, sf):
    """B-2: taboo prompt for every (run, label, seed), seeds = sources of the
    label's documents, words = the label's top three (``taboo_words_by_count``)."""
    from divspark.functions import prompts as P
    from divspark.operators.joins import join_small

    t = W.top_words(_label_scores(spark, sf), RUN, 3, score="score")
    lab = labelled(spark, sf)
    src = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("seed"))
    seeds = lab.join(src, "doc_id").select("run", "label", "seed").distinct()
    j = join_small(seeds, t, ["run", "label"])
    return j.select("run", "label", "seed", P.taboo_prompt("seed", "words").alias("prompt"))


@register("svm_vocabulary", f"""
WITH l AS ({LABELLED_SQL}),
toks AS (SELECT run, unnest({_TOKS}) AS word FROM l WHERE text IS NOT NULL),
freq AS (SELECT run, word, count(*) AS freq FROM toks GROUP BY run, word),
labs AS (SELECT run, label FROM l WHERE text IS NOT NULL GROUP BY run, label
         HAVING count(*) < (SELECT count(*) FROM l l2 WHERE l2.run = l.run AND l2.text IS NOT NULL)),
rl AS (SELECT DISTINCT run, label FROM labs)
SELECT rl.run, rl.label, f.word, f.freq FROM rl JOIN freq f ON rl.run = f.run""")
def svm_vocabulary(spark, sf):
    """T-1 / G-3: for every (run, label) problem with
    both classes present, the run's whole vocabulary and each word's corpus
    frequency."""
    return W.svm_coefficients(labelled(spark, sf), RUN).select("run", "label", "word", "freq")
