"""Spelling variants, whitening and toxic passages against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from divspark.llm import op11_spelling_variants as V
from divspark.llm import op12_embedding_whitening as W
from divspark.llm import op13_toxicity as T
from tests.llm.helpers import SCHEMA, frame

EMPTY = "doc_id long, text string"


# ---------------------------------------------------------------- op 11

def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(docs, min_length=V.MIN_LENGTH, min_count=V.MIN_COUNT, ratio=V.RATIO):
    import re

    count = Counter()
    for i, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            if len(run) >= min_length:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, around in near.items():
        if around:
            best = min(around, key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def variant_docs(seed=3):
    rng = random.Random(seed)
    stems = ["alphabeta", "übergang", "résumées", "mississippi", "aaaaaaaa", "thandther", "ofthemen"]
    words = set(stems)
    for s in stems:
        for _ in range(25):
            w = list(s)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice("aeté")], [w[k], rng.choice("aeté")]])
            words.add("".join(w))
    words = sorted(words)
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice([w, w.upper()]) for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60))))
    rows += [(150, "chainwordabc " * 5 + "chainwordab " * 30 + "chainworda " * 200)]
    rows += [(200, None), (201, ""), (202, "1234 --"), (None, " ".join(words)), (3, rows[3][1]), (3, rows[3][1]),
             (203, ("x" * 3000 + " ") * 6 + ("x" * 3001 + " ") * 6)]
    return rows


def got_variants(df, **kw):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in V.variants(df, **kw).collect()}


def test_variants_equal_all_pairs(spark):
    docs = variant_docs()
    df = spark.createDataFrame(docs, EMPTY).repartition(5)
    for name in ("word", "n", "form", "root", "tile", "g"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    want = brute_variants(docs)
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    assert got_variants(df) == want


def test_variants_with_tiny_blocks(spark, monkeypatch):
    """Groups cut into many blocks: every pair still met exactly once."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(V, "block_rows", lambda length: F.lit(3))
    docs = variant_docs(8)
    assert got_variants(spark.createDataFrame(docs, EMPTY)) == brute_variants(docs)


def test_variants_of_nothing(spark):
    assert V.variants(spark.createDataFrame([], EMPTY)).collect() == []
    assert V.variants(spark.createDataFrame([(1, None), (2, "short wörd")], EMPTY)).collect() == []
    assert V.variants(frame(spark)).count() >= 0
    assert SCHEMA


def test_ties_go_to_the_smallest_word(spark):
    docs = [(1, "castle " * 5 + "casble " * 50 + "cascle " * 50)]
    by = {r[0]: r for r in got_variants(spark.createDataFrame(docs, EMPTY))}
    assert by["castle"][1] == "casble" and by["castle"][4] == 2


# ---------------------------------------------------------------- op 12

def vectors(seed=1, n=60, dim=5):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in (rng.normal(size=dim) @ np.diag(np.arange(1, dim + 1)) * 0.4)]) for k in range(n)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (101, None), (102, [1.0, None, 2.0, 3.0, 4.0]),
             (103, [float("nan")] * dim), (104, [float("inf")] + [0.0] * (dim - 1)), (105, []), (106, [1.0, 2.0])]
    return rows


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for name in ("x", "v", "n", "component", "whitened"):
        df = df.withColumn(name, df["vec_id"].cast("string"))
    return df


def test_whitening_equals_brute_force(spark):
    rows = vectors()
    good = [(i, v) for i, v in rows if v and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: np.array([int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in good}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    y = n * fit - s
    cov = (y.T @ y).astype(float) / n ** 3
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    out = W.whiten(vector_frame(spark, rows)).collect()
    assert len(out) == len(good) * 5
    assert sorted((repr(r["vec_id"]) for r in out)) == sorted(repr(i) for i, _ in good for _ in range(5))
    sign = {}
    for r in out:
        k = r["component"] - 1
        want = float((x[r["vec_id"]] - s / n) @ vector[:, k] / np.sqrt(value[k]))
        sign.setdefault(k, np.sign(want * r["whitened"]))
        assert r["whitened"] * sign[k] == pytest.approx(want, abs=1e-9)
        assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]] - s) ** 2).sum())
        assert r["explained"] == pytest.approx(value[k] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_squares_are_exact_beyond_63_bits():
    rng = random.Random(5)
    v = np.array([[rng.randrange(-(1 << 60), 1 << 60) for _ in range(3)] for _ in range(50)], dtype=np.int64)
    assert W.square_sums(v) == [sum(int(t) ** 2 for t in v[:, k]) for k in range(3)]
    assert W.square_sums(v[:0]) == [0, 0, 0]


def test_polarised_sums_give_every_covariance():
    rng = np.random.default_rng(2)
    x = rng.integers(10 ** 6 - 50, 10 ** 6 + 50, size=(40, 6))
    n, s = len(x), x.sum(axis=0)
    q = dict(enumerate(W.polarised(x, n, s)))
    y = n * x - s
    assert np.allclose(W.covariance(q, n, 6), (y.T @ y) / n ** 3, rtol=1e-14)


def test_whitening_without_rank(spark):
    same = [(k, [1.0, 2.0]) for k in range(4)]
    assert W.whiten(vector_frame(spark, same)).collect() == []
    assert W.whiten(vector_frame(spark, [(1, None), (2, [])])).collect() == []
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(6)]
    assert {r["component"] for r in W.whiten(vector_frame(spark, line)).collect()} == {1}


# ---------------------------------------------------------------- op 13

def brute_segments(scores, drift, n):
    """Maximal scoring segments by their definition: take the best (shortest, leftmost),
    then go on left and right of it."""
    value = [-drift] * n
    for k, s in scores:
        value[k] = s

    def split(a, b):
        best = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += value[j]
                if t > 1e-9 and (best is None or t > best[0] + 1e-9):
                    best = (t, i, j)
        return [] if best is None else [*split(a, best[1]), best, *split(best[2] + 1, b)]
    return split(0, n)


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        scores = [(k, rng.uniform(-2, 5)) for k in range(n) if rng.random() < 0.4]
        got = [(round(s, 6), a, b) for s, a, b in T.segments(scores, 0.45)]
        assert got == [(round(s, 6), a, b) for s, a, b in brute_segments(scores, 0.45, n)]


def test_segments_in_linear_time():
    import time
    scores = [(k, 1.0 if k % 2 else -0.999) for k in range(400_000)]
    t = time.perf_counter()
    T.segments(scores, 0.1)
    T.segments([(3 * k, 0.5) for k in range(400_000)], 0.2)
    assert time.perf_counter() - t < 10


def test_decay_rate_solves_its_equation():
    scores = {-0.2: 1000.0, 2.0: 60.0, 4.0: 5.0}
    rate = T.decay(scores)
    total = sum(scores.values())
    assert sum(c / total * np.exp(rate * s) for s, c in scores.items()) == pytest.approx(1.0, abs=1e-9)
    assert T.decay({-0.2: 10.0}) == 1.0


def toxic_docs(seed=9, n=900):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdelmnorst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(20, 120))
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["zzidiot", "qqscum", "vequ" + rng.choice(plain)]))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_docs()
    truth = dict(labels)
    extra = [(5000, None), (5001, ""), (5002, "!! --"), (None, docs[0][1]), (5, docs[5][1]), (5003, "word " * 50_000)]
    df = spark.createDataFrame(docs + extra, EMPTY).repartition(4)
    for name in ("y", "score", "toxic", "weight", "h", "held_out"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    lab = spark.createDataFrame([*labels, (None, 1), (7000, None), (3, truth[3])], "doc_id long, toxic int")
    out = T.score_toxicity(df, lab).collect()
    assert len(out) == len(docs) + len(extra)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    odd = {r["doc_id"]: r for r in out if r["doc_id"] in (5000, 5001, 5002, 5003)}
    assert len(odd) == 4 and all(r["predicted"] == 0 and r["passages"] == [] for r in odd.values())
    found = next(r for r in out if r["predicted"] and r["doc_id"] is not None)
    words = T.tokens(dict(docs)[found["doc_id"]])
    for p in found["passages"]:
        assert T.tokens(p["text"]) == words[p["first"]:p["last"] + 1] and p["score"] > 0


def test_copies_weigh_like_one(spark):
    """A template copied under mostly toxic labels does not make its words toxic."""
    docs, labels = toxic_docs(11, 500)
    base = " ".join(f"template{k}" for k in range(60))
    docs += [(10_000 + k, base) for k in range(60)]
    labels += [(10_000 + k, int(k % 3 > 0)) for k in range(60)]
    out = T.score_toxicity(spark.createDataFrame(docs, EMPTY), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(r["evidence"] == 0 for r in out.where("doc_id >= 10000").collect())


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], EMPTY)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in T.score_toxicity(df, none).collect()] == [0, 0]
    assert T.score_toxicity(df.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert T.score_toxicity(df, one).count() == 2
