"""Final assembly of training sets (A-1 .. A-6).

``pd.concat([round0, method_round, seeds]).drop_duplicates('text')`` keeps
the first occurrence of a text in concat order.  Here that is an aggregate on
(keys, text, method) taking the minimum of ``(priority, salted hash, label,
seed)``: partial aggregation runs map-side, so a text repeated across a third of
all rows is combined before the shuffle and no window ever holds such a group.
Round 0 and the seeds, which every method shares, are shuffled once, not once
per method.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divspark.functions.text import dequote, order_key
from divspark.operators.filters import REFUSAL_MARKER
from divspark.operators.joins import join_small

# Fixed value: the method grid named by the trainers ('comb' is named but never produced).
METHODS = ("prompt", "taboo", "chaining", "hints", "taboo_ablt", "chaining_ablt", "hints_ablt")


def ordered_union(parts: Sequence[DataFrame], priority: str = "priority") -> DataFrame:
    """A-1 ``pd.concat(parts, ignore_index=True)`` with each part's position kept."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn(priority, F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def first_wins(df: DataFrame, keys: Sequence[str], *, text: str = "text", priority: str = "priority",
               salt: str = "0", carry: Sequence[str] = ("label", "seed")) -> DataFrame:
    """A-2 ``drop_duplicates('text')`` after an ordered union: per (keys, text)
    the row of lowest priority wins; inside a priority a salted hash of run, text and
    carried columns decides (the reference's in-file order is a random shuffle)."""
    carry = [c for c in carry if c in df.columns]
    best = F.min(F.struct(F.col(priority).alias("p"), order_key(text, salt, *keys, *carry).alias("h"),
                          *[F.col(c).alias(c) for c in carry])).alias("_best")
    agg = df.groupBy(*keys, text).agg(best)
    return agg.select(*keys, text, F.col("_best.p").alias(priority), *[F.col(f"_best.{c}").alias(c) for c in carry])


def assemble(round0: DataFrame, method_round: DataFrame, seeds: DataFrame, keys: Sequence[str], *,
             method: str = "method", text: str = "text", label: str = "label",
             filter_scope: str = "method", unfiltered_methods: Sequence[str] = ("prompt",),
             plain_methods: Sequence[str] = ("prompt",), salt: str = "0") -> DataFrame:
    """A-5 one training set per (keys, method).

    * ``round0``: ``(keys, label, text, seed)``, rows with any null dropped;
    * ``method_round``: ``(keys, method, label, text, seed)``; plain methods drop
      rows with any null, the others only rows with a null text;
    * ``seeds``: ``(keys, text, label)``, rows with any null dropped.

    ``filter_scope='method'`` removes refusal rows (``paraphra``) from the method
    round before the union, except for ``unfiltered_methods``; ``'all'`` removes
    them from the deduplicated union.  Quotes are removed after the dedup (A-4),
    so two texts may become equal again: both are kept.
    Output: ``(keys, method, text, label)``.
    """
    if filter_scope not in ("method", "all"):
        raise ValueError("filter_scope must be 'method' or 'all'")
    if not keys:  # one implicit run: a constant key instead of a cross join
        one = F.lit(0).alias("_run")
        out = assemble(round0.select("*", one), method_round.select("*", one), seeds.select("*", one), ["_run"],
                       method=method, text=text, label=label, filter_scope=filter_scope,
                       unfiltered_methods=unfiltered_methods, plain_methods=plain_methods, salt=salt)
        return out.drop("_run")
    r0 = round0.select(*keys, label, text, "seed").na.drop("any")
    plain = F.col(method).isin(*plain_methods)
    mr = method_round.select(*keys, method, label, text, "seed").where(
        F.col(text).isNotNull() & (~plain | (F.col(label).isNotNull() & F.col("seed").isNotNull())))
    # a method whose rows are all refusals still gets its training set
    methods = (mr.where(F.col(text).isNotNull()).groupBy(*keys)
               .agg(F.array_sort(F.collect_set(method)).alias("_methods")))
    if filter_scope == "method":
        mr = mr.where(F.col(method).isin(*unfiltered_methods) | ~F.col(text).contains(REFUSAL_MARKER))
    sd = seeds.select(*keys, text, label).na.drop("any")
    # round 0 and seeds belong to every method: they are kept once per text and meet
    # the run's methods only after the texts have been brought together
    union = ordered_union([r0.withColumn(method, F.lit(None).cast("string")), mr,
                           sd.withColumn(method, F.lit(None).cast("string"))])
    best = F.min(F.struct("priority", order_key(text, salt, *keys, label, "seed").alias("h"), F.col(label).alias("l"),
                          F.col("seed").alias("s")))
    per_slot = union.groupBy(*keys, text, method).agg(best.alias("b"))
    per_text = per_slot.groupBy(*keys, text).agg(F.collect_list(F.struct(F.col(method).alias("m"), "b")).alias("_e"))
    every = join_small(per_text, methods, list(keys), null_safe=True).withColumn(method, F.explode("_methods"))
    first = F.array_min(F.transform(F.filter("_e", lambda e: e["m"].isNull() | (e["m"] == F.col(method))),
                                    lambda e: e["b"]))
    won = (every.withColumn("_won", first).where(F.col("_won").isNotNull())
           .select(*keys, method, text, F.col("_won.l").alias(label)))
    won = won.where(F.col(text).isNotNull())
    if filter_scope == "all":
        won = won.where(~F.col(text).contains(REFUSAL_MARKER))
    return won.select(*keys, method, dequote(text).alias(text), label)
