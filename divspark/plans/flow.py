"""End-to-end augmentation over any number of runs (the collection scripts'
whole loop, then the final assembly), as Spark jobs.

Every model call (generation, encoding) is written to a table and read back
before it is used: lineage never re-runs a model, a lost executor only
recomputes from the last written table, and each stage of the reference
(``seeds.csv``, ``*_0_seeds.csv``, ``*_1_taboo.csv`` ...) is a Parquet table
partitioned by the run key.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divspark.functions import prompts as P
from divspark.operators import generate as G
from divspark.operators import outliers as O
from divspark.operators import words as W
from divspark.operators.assembly import assemble
from divspark.operators.joins import join_small
from divspark.operators.parse import parse_responses
from divspark.operators.sampling import stratified_sample
from divspark.sources.csv_io import write_runs


def augment_runs(train: DataFrame, generate_fn: Callable, encoder: Callable, out_dir: str, *,
                 keys: Sequence[str] = ("dataset",), n_seeds: int = 6, profile: str = "gpt",
                 taboo_k: int = W.TABOO_WORDS, n_hints: int = 3, hint_template: str = P.HINT_TEMPLATE_LOCAL,
                 entity_fn: Callable | None = None, ablations: bool = False, salt: str = "0",
                 filter_scope: str = "method", per_prompt: bool = False,
                 max_calls_per_second: float | None = None, partitions: int | None = None,
                 max_failed: float = 0.1) -> dict[str, DataFrame]:
    """Seeds -> round 0 and plain round 1 -> taboo, chaining and hint rounds
    (plus the random ablations) -> one training set per (run, method).

    ``train``: ``(keys, text, label)``.  ``generate_fn`` / ``encoder`` /
    ``entity_fn`` are the user's model functions (see ``operators.generate``);
    ``partitions`` / ``max_calls_per_second`` bound how many model calls run at
    once and how fast.  Failed prompts stay in the ``raw_*`` tables with their
    errors; a round with a larger share of them than ``max_failed`` raises.  Returns the written tables by name.
    """
    spark = train.sparkSession
    keys = list(keys)
    tables: dict[str, DataFrame] = {}

    def store(df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(out_dir, name)
        write_runs(df, path, keys)
        tables[name] = spark.read.parquet(path)
        return tables[name]

    def collect_round(prompts: DataFrame, name: str) -> DataFrame:
        raw = store(G.generate_responses(prompts, generate_fn, per_prompt=per_prompt,
                                         max_calls_per_second=max_calls_per_second, partitions=partitions),
                    f"raw_{name}")
        share = raw.agg(F.avg(F.col("error").isNotNull().cast("double"))).first()[0] or 0.0
        if share > max_failed:
            raise RuntimeError(f"{name}: {share:.1%} of the prompts failed (see the table raw_{name})")
        return store(parse_responses(raw.where(F.col("error").isNull()), profile, keys), name)

    # F-1 seeds, B-1 plain prompts, two plain rounds
    seeds = store(stratified_sample(train.where(F.col("text").isNotNull()), keys, n_seeds, salt=salt)
                  .select(*keys, "text", "label"), "seeds")
    plain = seeds.select(*keys, "label", F.col("text").alias("seed"), P.plain_prompt("text").alias("prompt"))
    r0 = collect_round(plain, "round0")
    rounds = {"prompt": collect_round(plain, "round1_prompt")}
    seed_sets = O.label_seed_sets(r0, keys)

    # taboo words (T-1 .. T-8), optionally the random ablation (T-9)
    docs = r0.withColumn("doc_id", F.xxhash64("label", "text", "seed"))
    # carries the run's word frequencies; stored once, read by both taboo variants
    coef = store(W.svm_coefficients(docs, keys), "taboo_coefficients")
    ents = None
    if entity_fn is not None:
        spans = G.entity_spans(seed_sets, entity_fn, keys)
        ents = W.entity_words(spans, [*keys, "label"])
    cand = W.taboo_candidates(coef, None, keys, entities=ents)
    variants = [("taboo", False)] + ([("taboo_ablt", True)] if ablations else [])
    for method, rnd in variants:
        taboo = W.top_words(cand, keys, taboo_k, random=rnd, salt=salt)
        pr = join_small(seed_sets, taboo, [*keys, "label"], "left", null_safe=True)
        pr = pr.select(*keys, "label", "seed",
                       P.taboo_prompt("seed", F.coalesce("words", F.array().cast("array<string>"))).alias("prompt"))
        rounds[method] = collect_round(pr, f"round1_{method}")

    # chaining and hints on round-0 embeddings (K-1 .. K-7)
    emb = store(G.embed_texts(r0, encoder), "round0_embeddings")
    out = store(O.centroid_distance(emb, keys).drop("embedding"), "round0_outliers")   # read by four rounds
    for method, rnd in [("chaining", False)] + ([("chaining_ablt", True)] if ablations else []):
        ch = O.chaining_seeds(out, r0, keys, random=rnd, salt=salt)
        pr = ch.select(*keys, "label", F.col("text").alias("seed"), P.plain_prompt("text").alias("prompt"))
        rounds[method] = collect_round(pr, f"round1_{method}")
    for method, rnd in [("hints", False)] + ([("hints_ablt", True)] if ablations else []):
        h = O.hint_lists(O.hints_per_seed(out, r0, keys, n_hints, random=rnd, salt=salt), keys)
        pr = join_small(seed_sets, h, [*keys, "seed"], "left", null_safe=True)
        pr = pr.select(*keys, "label", "seed",
                       P.hint_prompt("seed", F.coalesce("hints", F.array().cast("array<string>")),
                                     hint_template).alias("prompt"))
        rounds[method] = collect_round(pr, f"round1_{method}")

    # A-1 .. A-5 one training set per method
    method_round = None
    for method, df in rounds.items():
        part = df.withColumn("method", F.lit(method))
        method_round = part if method_round is None else method_round.unionByName(part)
    store(assemble(r0, method_round, seeds, keys, filter_scope=filter_scope, salt=salt), "training_sets")
    return tables
