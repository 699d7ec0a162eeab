import re

import numpy as np

from divspark.operators import words as W
from tests.conftest import rows


def test_svm_coefficients_separable(spark):
    docs = [("r", i, 1 if i < 10 else 0, ("alpha beta " if i < 10 else "gamma delta ") + f"w{i}")
            for i in range(20)]
    df = spark.createDataFrame(docs, "run string, doc_id long, label int, text string")
    coef = W.svm_coefficients(df, ["run"]).toPandas()
    c1 = coef[coef["label"] == 1].set_index("word")["coefficient"]
    c0 = coef[coef["label"] == 0].set_index("word")["coefficient"]
    assert c1["alpha"] > 0 and c1["gamma"] < 0
    assert np.allclose(c1.sort_index(), -c0.sort_index())   # complementary one-vs-rest problems


def brute_dual(x, y, cost=1.0, tol=1e-9):
    """Pairwise dual ascent (the free intercept keeps sum(a y) at 0): weights and objective."""
    k, a = x @ x.T, np.zeros(len(y))
    while True:
        g = y - k @ (a * y)                                     # y_i times the dual's derivative
        up = np.where(((y > 0) & (a < cost)) | ((y < 0) & (a > 0)), g, -np.inf)
        low = np.where(((y > 0) & (a > 0)) | ((y < 0) & (a < cost)), g, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < tol:
            break
        t = (up[i] - low[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = min(t, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
    w = x.T @ (a * y)
    return w, a.sum() - w @ w / 2


def word_docs(seed, n=60, labels=3):
    rng = np.random.default_rng(seed)
    words = [f"word{k}" for k in range(25)]
    weight = 1 / np.arange(1, 26)
    out = []
    for i in range(n):
        label = i % labels
        p = weight * (1 + 2 * (np.arange(25) % labels == label))
        out.append(("r", i, label, " ".join(rng.choice(words, size=12, p=p / p.sum()))))
    return out, words


def compare_with_dual(spark, docs, words, labels, tolerance, **options):
    df = spark.createDataFrame(docs, "run string, doc_id long, label int, text string")
    coef = W.svm_coefficients(df, ["run"], stop_words=[], tolerance=tolerance, **options).toPandas()
    x = np.array([[d[3].split().count(w) for w in words] for d in docs], dtype=float)
    for label in range(labels):
        y = np.array([1.0 if d[2] == label else -1.0 for d in docs])
        w, dual = brute_dual(x, y)
        own = coef[coef["label"] == label].set_index("word")
        assert (own["gap"] < tolerance).all()
        near = tolerance * max(1, own["objective"].iloc[0]) + 1e-6
        assert -1e-6 <= own["objective"].iloc[0] - dual <= near
        got = np.array([own["coefficient"].get(v, 0.0) for v in words])
        # strong convexity: half the squared distance of the weights is at most the gap
        assert np.linalg.norm(got - w) ** 2 / 2 <= near
        yield own, dict(zip(words, w)), got


def test_svm_equals_a_brute_force_dual(spark):
    docs, words = word_docs(4)
    for own, want, _ in compare_with_dual(spark, docs, words, 3, 1e-6):
        rank = sorted((w for w in words if own["freq"].get(w, 0) >= 5), key=lambda v: want[v])
        mine = sorted(rank, key=lambda v: own["coefficient"][v])
        assert mine[-3:] == rank[-3:]                            # the taboo words


def test_svm_of_two_labels_is_one_problem(spark):
    docs, words = word_docs(6, n=40, labels=2)
    both = [got for _, _, got in compare_with_dual(spark, docs, words, 2, 1e-5)]
    assert np.allclose(both[0], -both[1])


def test_svm_in_blocks_reaches_the_same_optimum(spark):
    docs, words = word_docs(7, n=14, labels=2)
    list(compare_with_dual(spark, docs, words, 2, 0.05, block_values=90))


def test_svm_of_odd_runs(spark):
    """A run of one label has no problem; a document without words counts; many runs at once."""
    docs = [("one", 1, 0, "alpha beta"), ("one", 2, 0, "beta"), ("two", 3, 0, "alpha alpha"), ("two", 4, 1, "beta gamma"),
            ("two", 5, 1, "!"), ("two", 6, None, "alpha"), ("two", 7, 0, None)]
    df = spark.createDataFrame(docs, "run string, doc_id long, label int, text string")
    got = W.svm_coefficients(df, ["run"]).collect()
    assert {(r["run"], r["label"], r["word"]) for r in got} == {("two", y, w) for y in (0, 1) for w in ("alpha", "beta", "gamma")}
    assert all(r["gap"] < 1e-3 for r in got)


def test_taboo_candidates_and_top_words(spark):
    coef = spark.createDataFrame([("r", 0, w, c) for w, c in
                                  [("a", 0.1), ("b", 0.5), ("c", 0.9), ("d", 0.7), ("12", 2.0), ("ent", 3.0), ("rare", 5.0)]],
                                 "run string, label int, word string, coefficient double")
    freq = spark.createDataFrame([("r", w, f) for w, f in
                                  [("a", 5), ("b", 6), ("c", 9), ("d", 5), ("12", 9), ("ent", 9), ("rare", 4)]],
                                 "run string, word string, freq long")
    ents = spark.createDataFrame([("ent",)], "word string")
    cand = W.taboo_candidates(coef, freq, ["run"], entities=ents)
    assert sorted(r["word"] for r in cand.collect()) == ["a", "b", "c", "d"]
    top = W.top_words(cand, ["run"], 3).first()["words"]
    assert top == ["b", "d", "c"]                               # last three of the ascending sort
    rnd = W.top_words(cand, ["run"], 3, random=True, salt="1").first()["words"]
    assert len(rnd) == 3 and set(rnd) <= {"a", "b", "c", "d"}


def test_entity_words(spark):
    spans = spark.createDataFrame([("New York",), ("york  city",)], "span string")
    assert rows(W.entity_words(spans), "word") == [("city",), ("new",), ("york",)]


def test_counts_and_frequencies(spark):
    df = spark.createDataFrame([("r", 1, "The cat, the CAT! and a dog"), ("r", 2, None)],
                               "run string, doc_id long, text string")
    cm = rows(W.count_matrix(df, ["run"]), "word", "count")
    # 'the' (lower case) is a stop word; 'The' survives the case-sensitive filter then is lower-cased
    assert cm == [("cat", 2), ("dog", 1), ("the", 1)]
    assert rows(W.token_frequencies(df, ["run"]), "word", "freq") == cm


def test_every_run_has_its_own_optimum(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}x" for k in range(25)]
    data = [(f"r{i % 3}", i, int(rng.integers(0, 3)), " ".join(rng.choice(words, 12))) for i in range(90)]
    df = spark.createDataFrame(data, "run string, doc_id long, label int, text string").repartition(7)
    got = W.svm_coefficients(df, ["run"]).toPandas()
    for run in ("r0", "r1", "r2"):
        part = [d for d in data if d[0] == run]
        x = np.array([[t.split().count(w) for w in words] for *_, t in part], dtype=float)
        for label in {d[2] for d in part}:
            _, dual = brute_dual(x, np.array([1.0 if d[2] == label else -1.0 for d in part]))
            mine = got[(got["run"] == run) & (got["label"] == label)]["objective"].iloc[0]
            assert -1e-6 <= mine - dual <= 1e-3 * max(1, mine)

def test_random_words_differ_by_run_and_label(spark):
    cand = spark.createDataFrame([(r, lab, f"w{k}", 1.0, 9) for r in "ab" for lab in range(3) for k in range(12)],
                                 "run string, label int, word string, coefficient double, freq long")
    got = {tuple(r["words"]) for r in W.top_words(cand, ["run"], 3, random=True).collect()}
    assert len(got) > 3


def test_phrase_spans_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["New", "york", "city", "the", "a", "São", "paulo"]
    texts = [" ".join(rng.choice(words, size=rng.integers(0, 12))).replace(" ", "\n  ", 1) for _ in range(60)] + [None, ""]
    docs = [("r", k % 3, t) for k, t in enumerate(texts)]
    phrases = ["new york", "NEW  York City", "the", "são paulo a the", "york", "missing here", " ", None, "the the", "ork"]
    df = spark.createDataFrame(docs, "run string, label int, seed string")
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = set()
    for run, label, t in docs:
        for p in phrases:
            have, part = (t or "").lower().split(), (p or "").lower().split()
            if part and any(have[i:i + len(part)] == part for i in range(len(have))):
                want.add((run, label, " ".join(part)))
    got = W.phrase_spans(df, table, ["run"])
    assert got.columns == ["run", "label", "span"] and rows(got) == sorted(want, key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # the phrases met in a shuffle
    try:
        assert rows(W.phrase_spans(df, table, ["run"])) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert W.phrase_spans(df, table.where("false"), ["run"]).count() == 0


def test_svm_of_a_large_run_on_a_working_set(spark, monkeypatch):
    """A run of several blocks whose optimum rests on few documents is solved without rounds over all blocks."""
    from divspark.operators import linear

    def rounds(*_):
        raise AssertionError("the rounds over all blocks were needed")
    monkeypatch.setattr(linear, "_in_rounds", rounds)
    monkeypatch.setattr(linear, "FIRST", 20)
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(40)]
    docs = []
    for i in range(400):
        p = 1 + 40 * (np.arange(40) % 2 == i % 2)
        docs.append(("r", i, i % 2, " ".join(rng.choice(words, size=12, p=p / p.sum()))))
    for own, want, got in compare_with_dual(spark, docs, words, 2, 1e-3, block_values=2200):
        assert np.allclose(got, [want[w] for w in words], atol=0.1)


def test_best_intercept(spark):
    from divspark.operators import linear

    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 30):
        margin, sign = rng.normal(size=(n, 3)), rng.choice([-1.0, 0.0, 1.0], size=(n, 3))
        own = linear.best_intercept(margin, sign)
        loss = lambda b: (np.maximum(0, 1 - sign * (margin + b)) * (sign != 0)).sum(axis=0)
        tried = np.min([loss(b) for b in np.arange(-6, 6, 0.01)], axis=0)
        assert (loss(own) <= tried + 1e-9).all()


def rows_of(x, sign, cost=1.0):
    from divspark.operators import linear

    at = [np.flatnonzero(r) for r in x]
    start = np.append(0, np.cumsum([len(k) for k in at]))
    return linear.Rows(start, np.concatenate([*at, np.zeros(0, int)]).astype(np.int64), np.concatenate([r[k] for r, k in zip(x, at)]),
                       sign, cost)


def test_svm_of_rows_that_differ_little_takes_few_sweeps(monkeypatch):
    """Pairs of texts that few words tell apart, short and long ones: sweeps alone need many thousands of visits."""
    from divspark.operators import linear

    monkeypatch.setattr(linear, "PLAIN_VALUES", 0, raising=False)
    monkeypatch.setattr(linear, "MOST_SWEEPS", 600)
    rng = np.random.default_rng(5)
    common = rng.poisson(0.3, size=(150, 300)) * rng.choice([1, 1, 30], size=(150, 1))
    x = np.repeat(common, 2, axis=0).astype(float)
    x = np.concatenate([x, np.zeros((300, 40))], axis=1)
    x[np.arange(300), 300 + rng.integers(0, 40, 300)] = 1
    sign = np.tile([1.0, -1.0], 150)[:, None]
    w, b, primal, dual, _ = linear.solve(rows_of(x, sign), 1e-3)
    assert linear.relative_gap(primal, dual).max() < 1e-3
    margin = x[:, np.flatnonzero(x.any(axis=0))] @ w + b
    assert np.allclose((w ** 2).sum(axis=0) / 2 + np.maximum(0, 1 - sign * margin).sum(axis=0), primal)


def test_svm_steps_reach_the_optimum_of_every_problem(monkeypatch):
    """Duals at both bounds, rows outside a problem, a problem of one sign, equal and empty rows."""
    from divspark.operators import linear

    monkeypatch.setattr(linear, "PLAIN_VALUES", 0, raising=False)
    monkeypatch.setattr(linear, "MOST_SWEEPS", 2000)
    rng = np.random.default_rng(6)
    x = rng.poisson(0.5, size=(80, 12)).astype(float)
    x[5:10], x[20] = x[4], 0
    sign = np.where(x[:, :1] + rng.normal(size=(80, 3)) > 0.5, 1.0, -1.0)
    sign = np.concatenate([sign, np.ones((80, 1))], axis=1)
    sign[::7, 1] = 0
    state = {}
    w, b, primal, dual, _ = linear.solve(rows_of(x, sign), 1e-5, state=state)
    used = np.flatnonzero(x.any(axis=0))
    for k in range(4):
        at = np.flatnonzero(sign[:, k])
        assert primal[k] - dual[k] < 1e-5 * max(1, primal[k])
        margin = x[:, used] @ w[:, k] + b[k]
        assert np.isclose((w[:, k] ** 2).sum() / 2 + np.maximum(0, 1 - sign[at, k] * margin[at]).sum(), primal[k])
        if k < 3:
            assert abs(brute_dual(x[at], sign[at, k])[1] - dual[k]) < 1e-3 * primal[k]
    again = linear.solve(rows_of(x, sign), 1e-5, duals=state["duals"], b=state["b"])
    assert np.allclose(again[2], primal, rtol=1e-4, atol=1e-4)


def test_svm_passes_leave_the_rows_in_place(spark, monkeypatch):
    """A pass over the documents of a large run moves weights only, packed, also in several packs."""
    from divspark.operators import linear

    plans, materialize = [], linear.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)
    monkeypatch.setattr(linear, "materialize", seen)
    monkeypatch.setattr(linear, "FIRST", 20)
    monkeypatch.setattr(linear, "PACK", 7, raising=False)
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(40)]
    docs = []
    for i in range(200):
        p = 1 + 40 * (np.arange(40) % 2 == i % 2)
        docs.append(("r", i, i % 2, " ".join(rng.choice(words, size=12, p=p / p.sum()))))
    assert len(list(compare_with_dual(spark, docs, words, 2, 0.02, block_values=1600))) == 2
    passes = [p for p in plans if "FlatMapCoGroupsInArrow" in p and "measure" in p]
    assert passes and all(len(re.findall(r"Exchange hashpartitioning\(run#\d+, part#", p)) == 1 for p in passes)
