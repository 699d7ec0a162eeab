import numpy as np
import pandas as pd
import pytest

from divspark.operators import outliers as O
from tests.conftest import rows


@pytest.fixture(scope="module")
def round0(spark):
    rng = np.random.default_rng(3)
    data = []
    texts = [f"t{i}" for i in range(12)]
    for i in range(60):
        label = i % 3
        # 't0' is repeated across labels and seeds (a hot text)
        text = "t0" if i % 4 == 0 else texts[i % 12]
        data.append(("run", label, text, f"s{i % 5}", [float(x) for x in rng.normal(size=4)]))
    return spark.createDataFrame(data, "run string, label int, text string, seed string, embedding array<float>")


def _brute(round0):
    pdf = round0.toPandas()
    pdf["emb"] = pdf["embedding"].map(lambda v: np.array(v, dtype=np.float64))
    cent = pdf.groupby("label")["emb"].apply(lambda s: np.mean(np.stack(s.values), axis=0))
    pdf["distance"] = [float(np.linalg.norm(e - cent[lab])) for e, lab in zip(pdf["emb"], pdf["label"])]
    return pdf


def test_centroid_distance_matches_numpy(spark, round0):
    got = O.centroid_distance(round0, ["run"]).toPandas()
    exp = _brute(round0)
    assert np.allclose(sorted(got["distance"]), sorted(exp["distance"]), atol=1e-12)


def test_chaining_takes_n_distinct_seeds(spark, round0):
    out = O.centroid_distance(round0, ["run"])
    ch = O.chaining_seeds(out, round0, ["run"]).toPandas()
    exp = _brute(round0)
    for label, g in exp.groupby("label"):
        n = g["seed"].nunique()
        top = g.sort_values(["distance", "text"], ascending=[False, True]).head(n)
        assert sorted(ch[ch["label"] == label]["text"]) == sorted(top["text"])


def test_hints_equal_brute_force_merge(spark, round0):
    out = O.centroid_distance(round0, ["run"])
    got = O.hints_per_seed(out, round0, ["run"], 3).toPandas()
    # brute force: the reference's merge on text, distinct, projection, sort per seed
    exp = _brute(round0)
    o = exp[["label", "distance", "text"]].drop_duplicates()
    r = exp[["label", "text", "seed"]].drop_duplicates()
    merged = o.merge(r, on="text").drop_duplicates()[["label_x", "text", "distance", "seed"]]
    for seed, g in merged.groupby("seed"):
        top = g.sort_values(["distance", "text", "label_x"], ascending=[False, True, True]).head(3)
        mine = got[got["seed"] == seed].sort_values("hint_rank")
        assert list(mine["hint"]) == list(top["text"])
        assert np.allclose(mine["hint_distance"], top["distance"])


def test_attach_seeds_copies(spark):
    o = spark.createDataFrame([("r", 0, "a", 1.0)], "run string, label int, text string, distance double")
    r0 = spark.createDataFrame([("r", 0, "a", "s"), ("r", 1, "a", "s"), ("r", 1, "a", "s")],
                               "run string, label int, text string, seed string")
    got = rows(O.attach_seeds(o, r0, ["run"]), "label", "text", "seed", "copies")
    assert got == [(0, "a", "s", 2)]


def test_label_copies_switch(spark):
    o = spark.createDataFrame([("r", 0, "a", 2.0), ("r", 0, "b", 1.0)],
                              "run string, label int, text string, distance double")
    r0 = spark.createDataFrame([("r", 0, "a", "s"), ("r", 1, "a", "s"), ("r", 0, "b", "s")],
                               "run string, label int, text string, seed string")
    ref = [r["hint"] for r in O.hints_per_seed(o, r0, ["run"], 3).orderBy("hint_rank").collect()]
    plain = [r["hint"] for r in O.hints_per_seed(o, r0, ["run"], 3, label_copies=False).orderBy("hint_rank").collect()]
    assert ref == ["a", "a", "b"] and plain == ["a", "b"]
    assert rows(O.attach_seeds(o, r0, ["run"], label_copies=False), "text", "copies") == [("a", 1), ("b", 1)]


def test_centroid_methods_agree(spark, round0):
    a = {(r["label"]): r["centroid"] for r in O.centroids(round0, ["run"]).collect()}
    b = {(r["label"]): r["centroid"] for r in O.centroids(round0, ["run"], method="explode").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], rtol=0, atol=1e-12)
