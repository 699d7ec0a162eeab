"""Word statistics and taboo-word scoring (G-2, G-3, T-1 .. T-9).

Reference steps per run and label: stop-word removal, CountVectorizer counts,
a linear SVM of the label against all others, coefficients joined with corpus
frequencies, frequency floor, numeric and entity words removed, last ``k``
words by coefficient.

Counts and frequencies are exploded tokens aggregated with partial (map-side)
aggregation; the SVM (T-1) is solved over them to a certified gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divspark.functions.text import (is_digit_word, join_words, order_key, remove_stop_words,
                                     whitespace_tokens, word_tokens)
from divspark.operators import linear
from divspark.operators.joins import join_small
from divspark.operators.ranking import top_k
from divspark.session import materialize, stored

# Fixed values of the reference's taboo-word step.
TABOO_WORDS = 3
MIN_FREQUENCY = 5


def token_expr(text: str = "text", stop_words=None):
    """C-7 then C-8: ``CountVectorizer`` tokens of ``cleantext(text)``."""
    return word_tokens(join_words(remove_stop_words(text, stop_words)))


def doc_tokens(docs: DataFrame, keys: Sequence[str], *, doc: str | None = "doc_id", text: str = "text",
               stop_words=None) -> DataFrame:
    """Tokens of every document as an array column ``tokens``."""
    d = docs.where(F.col(text).isNotNull())
    return d.select(*keys, *([doc] if doc else []), token_expr(text, stop_words).alias("tokens"))


def token_rows(docs: DataFrame, keys: Sequence[str], *, doc: str | None = None, text: str = "text",
               stop_words=None) -> DataFrame:
    """One row per token.  The generator takes the expression itself: exploding
    an aliased array column lets Catalyst infer a ``size(tokens) > 0`` filter
    that would tokenise every text a second time, below any repartition."""
    d = docs.where(F.col(text).isNotNull())
    return d.select(*keys, *([doc] if doc else []), F.explode(token_expr(text, stop_words)).alias("word"))


def count_matrix(docs: DataFrame, keys: Sequence[str], *, doc: str = "doc_id", text: str = "text",
                 stop_words=None) -> DataFrame:
    """G-2 sparse count matrix, long form ``(keys, doc, word, count)``."""
    return (token_rows(docs, keys, doc=doc, text=text, stop_words=stop_words)
            .groupBy(*keys, doc, "word").agg(F.count(F.lit(1)).alias("count")))


def word_bags(docs: DataFrame, keys: Sequence[str], *, doc: str = "doc_id", text: str = "text",
              stop_words=None) -> DataFrame:
    """The rows of :func:`count_matrix`, one row per document with a word, stored: ``(keys, doc, words, xs)``,
    words in the order of their 64-bit hash, ``xs`` their counts.  Texts move once, and words are
    counted where their text lies."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # by number: as many tasks split the words
    dealt = docs.select(*keys, doc, text).repartition(n, *keys, doc)
    counts = count_matrix(dealt, keys, doc=doc, text=text, stop_words=stop_words)
    entry = F.sort_array(F.collect_list(F.struct(F.xxhash64("word").alias("id"), F.col("count").cast("int").alias("x"), "word")))
    return stored(counts.groupBy(*keys, doc).agg(entry.alias("e")).select(
        *keys, doc, F.col("e.word").alias("words"), F.col("e.x").alias("xs")), "word-bags")


def word_frequencies(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G-3 ``get_freqs``: corpus frequency of every word of a run (all labels),
    from a count table (``count_matrix`` or ``label_word_counts``)."""
    return counts.groupBy(*keys, "word").agg(F.sum("count").alias("freq"))


def token_frequencies(docs: DataFrame, keys: Sequence[str], *, text: str = "text",
                      stop_words=None) -> DataFrame:
    """G-3 straight from the token stream: one partial aggregation on (keys, word)."""
    return (token_rows(docs, keys, text=text, stop_words=stop_words)
            .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("freq")))


def label_word_counts(docs: DataFrame, keys: Sequence[str], *, label: str = "label", text: str = "text",
                      stop_words=None) -> DataFrame:
    """Word counts per (keys, label, word); summing over labels gives G-3."""
    return (token_rows(docs, [*keys, label], text=text, stop_words=stop_words)
            .groupBy(*keys, label, "word").agg(F.count(F.lit(1)).alias("count")))


def svm_coefficients(docs: DataFrame, keys: Sequence[str], *, label: str = "label", doc: str = "doc_id",
                     text: str = "text", stop_words=None, tolerance: float = linear.TOLERANCE,
                     block_values: int = linear.BLOCK_VALUES) -> DataFrame:
    """T-1 + T-2: one-vs-rest linear SVM (C = 1, free intercept) per (run, label) on
    stop-word-cleaned counts; the coefficient table ``(keys, label, word, coefficient,
    freq, objective, gap)``.

    Every word of the run has a row, with coefficient 0 where no support vector holds it.
    ``objective`` is the primal value ``||w||^2 / 2 + sum(hinge)`` of the (run, label)
    problem and ``gap`` its certified relative distance from the optimum, below
    ``tolerance`` (:mod:`divspark.operators.linear`).  ``freq``, the run's corpus frequency of the
    word (G-3), comes from the same counts.  Runs with a single label have no problem and
    give no rows.  Words are known to the solver by a 64-bit hash.
    """
    if not keys:  # one implicit run: a constant key
        return svm_coefficients(docs.withColumn("_run", F.lit(0)), ["_run"], label=label, doc=doc, text=text,
                                stop_words=stop_words, tolerance=tolerance, block_values=block_values).drop("_run")
    base = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(*keys, doc, label, text)
    bags = word_bags(base, keys, doc=doc, text=text, stop_words=stop_words)
    rows = materialize(base.select(*keys, doc, label).distinct())
    features = bags.select(*keys, doc, F.transform("words", lambda w: F.xxhash64(w)).alias("ids"), "xs")
    weights, facts = linear.fit(features, linear.one_against_rest(rows, keys, doc=doc, label=label), keys, doc=doc,
                                problem=[label], tolerance=tolerance, block_values=block_values)
    weights = linear.both_sides(weights, rows, keys, label=label, signed=["weight"])
    facts = linear.both_sides(facts, rows, keys, label=label, signed=["intercept"])
    words = bags.select(*keys, F.explode(F.arrays_zip("words", "xs")).alias("e"))
    freq = words.groupBy(*keys, F.col("e.words").alias("word")).agg(F.sum(F.col("e.xs")).alias("freq"))
    freq = freq.withColumn("id", F.xxhash64("word"))
    every = join_small(freq, facts.select(*keys, label, "objective", "gap"), list(keys))
    return (every.join(weights, [*keys, label, "id"], "left")
            .select(*keys, label, "word", F.coalesce("weight", F.lit(0.0)).alias("coefficient"), "freq", "objective", "gap"))


# --------------------------------------------------------------------------
# T-3 .. T-9
# --------------------------------------------------------------------------

def entity_words(spans: DataFrame, keys: Sequence[str] = (), span: str = "span") -> DataFrame:
    """T-6: words of entity spans (lower-cased, whitespace split), distinct."""
    return (spans.select(*keys, F.explode(whitespace_tokens(F.lower(F.col(span)))).alias("word"))
            .distinct())


def phrase_spans(df: DataFrame, phrases: DataFrame, keys: Sequence[str], *, label: str = "label",
                 text: str = "seed", phrase: str = "phrase") -> DataFrame:
    """T-6 / T-7 entity spans from a table of phrases instead of a model: distinct
    ``(keys, label, span)`` for every phrase that stands in ``lower(text)`` as whole words.

    Words are separated by white space and compared lower-cased; a phrase may have any
    number of them, and phrases may overlap.  Every run of as many words as some phrase has
    is looked up by its text, each distinct one of a row once, so a frequent first word costs nothing; the work
    is the words times the distinct phrase lengths.  The phrases are broadcast when their measured size allows, and otherwise met in a shuffle.
    Null and blank texts or phrases match nothing.
    """
    words = whitespace_tokens(F.lower(F.col(phrase)))
    table = materialize(phrases.select(words.alias("_w")).where(F.size("_w") > 0)
                        .select(F.array_join("_w", " ").alias("span"), F.size("_w").alias("_n")).distinct())
    lengths = sorted(r["_n"] for r in table.select("_n").distinct().collect())     # one row a length
    own = whitespace_tokens(F.lower(F.col(text)))

    def runs_of(w, n: int):
        last = F.size(w) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
    if not lengths:
        own, lengths = F.array().cast("array<string>"), [1]
    # the words are bound to a variable: named in every slice they would be split again for each
    every = F.flatten(F.transform(F.array(own), lambda w: F.array_distinct(F.concat(*[runs_of(w, n) for n in lengths]))))
    found = df.where(F.col(text).isNotNull()).select(*keys, label, F.explode(every).alias("span"))
    return join_small(found, table.select("span"), ["span"], "left_semi").select(*keys, label, "span").distinct()


def taboo_candidates(coefficients: DataFrame, frequencies: DataFrame | None, keys: Sequence[str], *,
                     label: str = "label", entities: DataFrame | None = None,
                     min_freq: int = MIN_FREQUENCY) -> DataFrame:
    """T-3 .. T-7: coefficients joined with frequencies, ``freq >= min_freq``,
    numeric words dropped, entity words dropped.

    ``frequencies`` may be None when the coefficient table already carries
    ``freq`` (as :func:`svm_coefficients` does).  ``entities`` holds ``word``
    plus any of ``keys`` / ``label`` it is specific to.
    """
    if frequencies is None:
        j = coefficients
    else:
        j = coefficients.drop(*[c for c in ("freq",) if c in coefficients.columns]).join(
            frequencies, [*keys, "word"], "left")
    j = j.where(F.col("freq") >= min_freq).where(~is_digit_word("word"))
    if entities is not None:
        on = [c for c in [*keys, label] if c in entities.columns] + ["word"]
        j = join_small(j, entities.select(*on).distinct(), on, "left_anti")
    return j


def top_words(candidates: DataFrame, keys: Sequence[str], k: int = TABOO_WORDS, *, label: str = "label",
              score: str = "coefficient", random: bool = False, salt: str = "0") -> DataFrame:
    """T-8 (``list[-k:]`` of the ascending sort) or T-9 (``random=True``: a
    salted-hash permutation of its own for every run and label, last k).  Output ``(keys, label, words)`` with
    the words in ascending score order (the reference's slot order)."""
    if random:
        order = [order_key("word", f"taboo:{salt}", *keys, label).desc(), F.col("word").desc()]
    else:
        order = [F.col(score).desc(), F.col("freq").desc(), F.col("word").desc()]
    ranked = top_k(candidates, [*keys, label], order, k, rank_col="_r")
    return (ranked.groupBy(*keys, label)
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col("word")))).alias("_w"))
            .select(*keys, label, F.col("_w.word").alias("words")))
