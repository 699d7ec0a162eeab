"""Property tests: operators against plain pandas formulations on random inputs
(duplicates, ties and nulls included)."""

import hashlib

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from divspark.functions.text import order_key
from divspark.operators.assembly import first_wins, ordered_union
from divspark.operators.ranking import rank_within, top_k

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
texts = st.sampled_from(["a", "b", "c", "d", "hot", None])
runs = st.sampled_from(["r1", "r2"])
rows = st.lists(st.tuples(runs, texts, st.integers(0, 3)), min_size=1, max_size=25)


def _md5(salt, t):
    return hashlib.md5(f"{salt}:{t}".encode()).hexdigest()


@SETTINGS
@given(parts=st.lists(rows, min_size=1, max_size=3))
def test_first_wins_matches_concat_drop_duplicates(spark, parts):
    dfs = [spark.createDataFrame(p, "run string, text string, label int") for p in parts]
    got = {(r["run"], r["text"], r["priority"], r["label"])
           for r in first_wins(ordered_union(dfs), ["run"], salt="s", carry=("label",)).collect()}
    frames = [pd.DataFrame(p, columns=["run", "text", "label"]).assign(priority=i) for i, p in enumerate(parts)]
    allp = pd.concat(frames, ignore_index=True)
    allp["h"] = [_md5(f"s:{r}:{lab}", t) if t is not None else None
                 for r, lab, t in zip(allp["run"], allp["label"], allp["text"])]
    allp["text_key"] = allp["text"].fillna("\0null")
    best = allp.sort_values(["priority", "h", "label"], na_position="first").drop_duplicates(["run", "text_key"])
    expect = {(r.run, r.text if r.text is not None else None, r.priority, r.label) for r in best.itertuples()}
    assert got == expect


@SETTINGS
@given(data=rows, parts=st.integers(1, 4))
def test_rank_within_and_top_k(spark, data, parts):
    df = spark.createDataFrame([(r, t, l, i) for i, (r, t, l) in enumerate(data)],
                               "run string, text string, label int, id long")
    order = [order_key("text", "q").asc(), F.col("id").asc()]
    got = {(r["id"], r["rank"]) for r in rank_within(df, ["run"], order, partitions=parts).collect()}
    pdf = pd.DataFrame([(r, t, l, i) for i, (r, t, l) in enumerate(data)], columns=["run", "text", "label", "id"])
    pdf["h"] = [_md5("q", t) if t is not None else None for t in pdf["text"]]
    pdf = pdf.sort_values(["run", "h", "id"], na_position="first")
    pdf["rank"] = pdf.groupby("run").cumcount() + 1
    assert got == set(zip(pdf["id"], pdf["rank"]))
    k = df.withColumn("k", (F.col("label") % 3) + 1)
    kept = {r["id"] for r in top_k(k, ["run"], order, "k").collect()}
    pdf["k"] = pdf["label"] % 3 + 1
    assert kept == set(pdf[pdf["rank"] <= pdf["k"]]["id"])


@SETTINGS
@given(sizes=st.lists(st.integers(0, 30), min_size=1, max_size=3), frac=st.sampled_from([0.05, 0.1, 0.25, 0.5, 0.9]))
def test_sample_fraction_sizes(spark, sizes, frac):
    from decimal import ROUND_HALF_EVEN, Decimal

    from divspark.operators.sampling import sample_fraction
    data = [(f"g{g}", f"t{g}-{i}") for g, n in enumerate(sizes) for i in range(n)]
    if not data:
        return
    df = spark.createDataFrame(data, "g string, text string")
    got = {r["g"]: r["count"] for r in sample_fraction(df, ["g"], frac).groupBy("g").count().collect()}
    for g, n in enumerate(sizes):
        want = int((Decimal(n) * Decimal(str(frac))).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))
        assert got.get(f"g{g}", 0) == want


@SETTINGS
@given(n=st.integers(1, 60), test_size=st.sampled_from([0.01, 0.1, 0.33]), reps=st.integers(1, 3))
def test_train_test_split_sizes(spark, n, test_size, reps):
    import math

    from divspark.operators.sampling import train_test_split
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(n)], "id long, text string")
    s = train_test_split(df, [], test_size, reps, tie=["id"]).collect()
    for r in range(reps):
        rows_r = [x for x in s if x["rep"] == r]
        assert sorted(x["id"] for x in rows_r) == list(range(n))          # every row once per repetition
        assert sum(x["is_test"] for x in rows_r) == math.ceil(test_size * n)
