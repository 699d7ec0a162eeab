"""Outlier selection for chaining and hints (G-1, G-4, K-2 .. K-7).

Rows are ``(keys..., label, text, seed, embedding)``; ``keys`` are the run-key
columns.  Every per-label loop of a script becomes a grouping on
``(keys, label)`` or ``(keys, seed)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divspark.functions.text import order_key
from divspark.operators.joins import join_small
from divspark.operators.ranking import top_k
from divspark.session import materialize


def label_seed_sets(df: DataFrame, keys: Sequence[str], label: str = "label",
                    seed: str = "seed") -> DataFrame:
    """G-1 ``groupby(label)[seed].apply(set)``, kept long: distinct (keys, label, seed)."""
    return df.select(*keys, label, seed).where(F.col(seed).isNotNull()).distinct()


def label_seed_counts(df: DataFrame, keys: Sequence[str], label: str = "label",
                      seed: str = "seed", out: str = "n_seeds") -> DataFrame:
    """G-1 when only the set size matters (K-3): distinct seeds per (keys, label)."""
    return (label_seed_sets(df, keys, label, seed)
            .groupBy(*keys, label).agg(F.count(F.lit(1)).alias(out)))


def centroids(df: DataFrame, keys: Sequence[str], label: str = "label",
              embedding: str = "embedding", out: str = "centroid", method: str = "summarizer") -> DataFrame:
    """G-4 mean embedding per (keys, label) as ``array<double>``.

    ``method='summarizer'`` (default) adds whole vectors in Spark ML's
    ``Summarizer`` aggregate (partial aggregation, no row per dimension);
    ``'explode'`` is the plain-SQL form, one ``avg`` per dimension over
    ``posexplode`` rows (D rows per embedding).
    """
    if method == "summarizer":
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        vec = array_to_vector(F.col(embedding).cast("array<double>"))
        return (df.where(F.col(embedding).isNotNull()).groupBy(*keys, label)
                .agg(Summarizer.mean(vec).alias("_m"))
                .select(*keys, label, vector_to_array("_m").alias(out)))
    ex = df.select(*keys, label, F.posexplode(embedding).alias("_pos", "_v"))
    per_dim = ex.groupBy(*keys, label, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return (per_dim.groupBy(*keys, label)
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_cm"))
            .select(*keys, label, F.transform("_cm", lambda s: s["_m"]).alias(out)))


def euclidean(a, b):
    """``np.linalg.norm(a - b)`` in double precision."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def centroid_distance(df: DataFrame, keys: Sequence[str], label: str = "label",
                      embedding: str = "embedding", out: str = "distance") -> DataFrame:
    """K-2 ``calculate_outliers``: each row's distance to its label centroid."""
    cent = centroids(df, keys, label, embedding, "_centroid")
    joined = join_small(df, cent, [*keys, label], null_safe=True)
    return joined.withColumn(out, euclidean(embedding, "_centroid")).drop("_centroid")


def chaining_seeds(outliers: DataFrame, round0: DataFrame, keys: Sequence[str], *,
                   label: str = "label", text: str = "text", seed: str = "seed",
                   distance: str = "distance", random: bool = False, salt: str = "0",
                   tie: Sequence[str] = ()) -> DataFrame:
    """K-3 / K-4: per (keys, label) the N farthest texts, N = distinct seeds of the label.

    ``random=True`` is the ablation (K-4): order by a salted hash of the text.
    Ties on distance are broken by text, then ``tie`` columns.
    """
    counts = materialize(label_seed_counts(round0, keys, label, seed, "_n"))
    k_max = counts.agg(F.max("_n")).first()[0]
    rows = join_small(outliers, counts, [*keys, label], null_safe=True, checkpoint=False)
    if random:
        order = [order_key(text, f"chaining:{salt}", *keys, label).asc(), F.col(text).asc(), *[F.col(c).asc() for c in tie]]
    else:
        order = [F.col(distance).desc(), F.col(text).asc(), *[F.col(c).asc() for c in tie]]
    return top_k(rows, [*keys, label], order, "_n", k_max=k_max or 0).drop("_n")


def attach_seeds(outliers: DataFrame, round0: DataFrame, keys: Sequence[str], *,
                 label: str = "label", text: str = "text", seed: str = "seed",
                 distance: str = "distance", label_copies: bool = True) -> DataFrame:
    """K-5 ``outliers.merge(round0, on='text').drop_duplicates()`` then projection.

    The reference drops duplicates *before* projecting away the round-0 label,
    so a (text, seed) held by several labels appears several times.  That
    multiplicity is kept as ``copies`` instead of repeating rows; duplicates
    on either side are removed before the join, so only distinct pairs meet.
    ``label_copies=False`` is the plain alternative (``copies`` is always 1).
    """
    o = outliers.select(*keys, label, text, distance).distinct()
    r = (round0.select(*keys, F.col(label).alias("_label_y"), text, seed).distinct()
         .groupBy(*keys, text, seed).agg(F.count(F.lit(1)).alias("copies")))
    if not label_copies:
        r = r.withColumn("copies", F.lit(1).cast("bigint"))
    return o.join(r, [*keys, text])


def hint_candidates_bounded(outliers: DataFrame, round0: DataFrame, keys: Sequence[str], n: int = 3, *,
                            label: str = "label", text: str = "text", seed: str = "seed",
                            distance: str = "distance", random: bool = False, salt: str = "0",
                            label_copies: bool = True):
    """The candidates of :func:`hints_per_seed` and their order: each text cut to
    its best ``n`` outlier rows, joined to its distinct seeds, repeated at most
    ``n`` times.  At most ``n * n`` rows per distinct (text, seed), however
    often a text repeats."""
    o = outliers.select(*keys, label, text, distance).distinct()
    if random:
        o = o.withColumn("_ord", order_key(text, f"hints:{salt}", *keys, label))
        order = [F.col("_ord").asc(), F.col(text).asc(), F.col(label).asc(), F.col(distance).asc()]
    else:
        o = o.withColumn("_ord", F.lit(""))
        order = [F.col(distance).desc(), F.col(text).asc(), F.col(label).asc()]
    o_top = top_k(o, [*keys, text], order, n, rank_col="_r").drop("_r")
    r = (round0.select(*keys, F.col(label).alias("_label_y"), text, seed).distinct()
         .groupBy(*keys, text, seed).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("_copies")))
    if not label_copies:
        r = r.withColumn("_copies", F.lit(1).cast("bigint"))
    cand = (o_top.join(r, [*keys, text])
            .withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
    return cand, order


def hints_per_seed(outliers: DataFrame, round0: DataFrame, keys: Sequence[str], n: int = 3, *,
                   label: str = "label", text: str = "text", seed: str = "seed",
                   distance: str = "distance", random: bool = False, salt: str = "0",
                   label_copies: bool = True) -> DataFrame:
    """K-6 / K-7 ``get_hint_sentences_per_labels``: top ``n`` hint texts per seed.

    Filter is by seed only (label ignored), order is distance descending (or a
    salted hash for the ablation).  Only the best ``n`` outlier rows of a text
    can reach any seed's top ``n``, so each text is cut to ``n`` rows before the
    join and each (text, seed) repeats at most ``n`` times: the join stays
    linear even for a text repeated across a third of the rows.
    ``label_copies=False`` drops the reference's repeated hints (a (text, seed)
    held by several labels counts once).
    Output: ``(keys, seed, hint_rank, hint, hint_label, hint_distance)``.
    """
    cand, order = hint_candidates_bounded(outliers, round0, keys, n, label=label, text=text, seed=seed,
                                          distance=distance, random=random, salt=salt, label_copies=label_copies)
    ranked = top_k(cand, [*keys, seed], [*order, F.col("_rep").asc()], n, rank_col="hint_rank")
    return ranked.select(*keys, seed, "hint_rank", F.col(text).alias("hint"),
                         F.col(label).alias("hint_label"), F.col(distance).alias("hint_distance"))


def hint_lists(hints: DataFrame, keys: Sequence[str], seed: str = "seed") -> DataFrame:
    """Hints of each seed as an ordered ``array<string>`` (at most ``n`` long)."""
    return (hints.groupBy(*keys, seed)
            .agg(F.array_sort(F.collect_list(F.struct("hint_rank", "hint"))).alias("_h"))
            .select(*keys, seed, F.transform("_h", lambda s: s["hint"]).alias("hints")))
