import pytest

from divspark.operators import generate as G
from tests.conftest import rows


class RateLimitError(Exception):
    pass


class Boom(Exception):
    pass


def test_retry_policy():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RateLimitError("slow down")
        return x * 2

    assert G.call_with_retry(flaky, 2, sleep=waits.append) == 4
    assert waits == [10.0, 10.0]
    with pytest.raises(Boom):                       # unknown errors propagate at once
        G.call_with_retry(lambda x: (_ for _ in ()).throw(Boom()), 1, sleep=waits.append)
    with pytest.raises(G.TooManyAttempts):
        G.call_with_retry(lambda x: (_ for _ in ()).throw(RateLimitError()), 1, sleep=lambda s: None)


def test_pacer():
    t = [0.0]
    slept = []
    p = G._Pacer(2.0, sleep=lambda s: (slept.append(s), t.__setitem__(0, t[0] + s)), clock=lambda: t[0])
    p.wait(); p.wait(); p.wait()
    assert slept == [0.5, 0.5]


def test_generate_responses_carries_columns_and_errors(spark):
    df = spark.createDataFrame([(0, "s1", "p1"), (1, "s2", "bad")], "label int, seed string, prompt string")

    def gen(prompts):
        if "bad" in prompts:
            raise Boom("no")
        return [[p.upper(), "second"] for p in prompts]

    out = G.generate_responses(df, gen, per_prompt=True)
    got = rows(out, "label", "seed", "response", "error")
    assert got[0] == (0, "s1", ["P1", "second"], None)
    assert got[1][2] is None and got[1][3].startswith("Boom")
    with pytest.raises(Exception):
        G.generate_responses(df, gen, per_prompt=True, fail_fast=True).collect()


def test_one_bad_prompt_of_a_batch_costs_only_itself(spark):
    df = spark.createDataFrame([(k, "bad" if k == 3 else f"p{k}") for k in range(20)], "k int, prompt string").coalesce(1)

    def gen(prompts):
        if "bad" in prompts:
            raise Boom("no")
        return [p.upper() for p in prompts]

    got = G.generate_responses(df, gen, partitions=0).collect()
    assert [r["k"] for r in got if r["error"]] == [3]
    assert all(r["response"] == [r["prompt"].upper()] for r in got if r["k"] != 3)


def test_embed_and_entities(spark):
    df = spark.createDataFrame([("r", 0, "New York trip"), ("r", 1, "none")], "run string, label int, seed string")
    e = G.embed_texts(df.withColumnRenamed("seed", "text"), lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert [r["embedding"] for r in e.orderBy("label").collect()] == [[13.0, 1.0], [4.0, 1.0]]
    ents = G.entity_spans(df, lambda ts: [["new york"] if "york" in t else [] for t in ts], ["run"])
    assert rows(ents, "run", "label", "span") == [("r", 0, "new york")]


def test_rate_is_the_whole_jobs(spark):
    """R-3: four tasks share one rate; the calls of all of them together keep it."""
    import time as clock
    from pyspark.sql import functions as F

    def stamped(prompts):
        return [str(clock.time()) for _ in prompts]
    df = spark.range(24).select(F.col("id").cast("string").alias("prompt"))
    for tasks in (2, 4):
        out = G.generate_responses(df, stamped, per_prompt=True, max_calls_per_second=20, partitions=tasks)
        at = sorted(float(r["response"][0]) for r in out.collect())
        assert len(at) == 24 and 23 / (at[-1] - at[0]) < 20 * 1.5
    with pytest.raises(ValueError):
        G.generate_responses(df, stamped, max_calls_per_second=20, partitions=0)


def test_generation_goes_on_where_it_stopped(spark, tmp_path):
    """S-5 / R-2: answered prompts are never sent again, failed ones are; repeats are sent once."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(broken):
        def run(prompts):
            import os
            import uuid
            for p in prompts:
                open(os.path.join(str(calls), f"{p}-{uuid.uuid4().hex}"), "w").close()
            if broken and any(p in ("b", "c") for p in prompts):
                raise ValueError("down")
            return [p.upper() for p in prompts]
        return run

    def sent():
        return sorted(f.name.split("-")[0] for f in calls.iterdir())
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None)], "k int, prompt string")
    log = str(tmp_path / "log")
    first = {r["k"]: r for r in G.generate_missing(df, model(True), log, per_prompt=True).collect()}
    assert first[1]["response"] == first[3]["response"] == ["A"] and first[2]["response"] is None
    assert first[2]["error"].startswith("ValueError") and first[1]["error"] is None
    assert first[5]["response"] is None and first[5]["error"] is None and sent() == ["a", "b", "c"]
    more = df.unionByName(spark.createDataFrame([(6, "d")], "k int, prompt string"))
    second = {r["k"]: r["response"] for r in G.generate_missing(more, model(False), log, per_prompt=True).collect()}
    assert second == {1: ["A"], 2: ["B"], 3: ["A"], 4: ["C"], 5: None, 6: ["D"]}
    assert sent() == ["a", "b", "b", "c", "c", "d"]
    G.generate_missing(more, model(True), log, per_prompt=True).collect()
    assert sent() == ["a", "b", "b", "c", "c", "d"]


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    import os
    import uuid

    from divspark.operators.generate import LoadedOnce, embed_texts
    seen = str(tmp_path)

    def load():
        open(os.path.join(seen, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[float(len(t)), float(os.getpid())] for t in texts]
    df = spark.range(400).selectExpr("id", "repeat('x', int(id % 7)) AS text").repartition(24)
    got = embed_texts(df, LoadedOnce(load), double=True).collect()      # 24 tasks
    assert all(r["embedding"][0] == r["id"] % 7 for r in got)
    loads = [int(f.split("-")[0]) for f in os.listdir(seen)]
    assert sorted(set(loads)) == sorted(loads) and set(loads) == {int(r["embedding"][1]) for r in got}
    assert len(loads) < 24


def test_entity_spans_come_a_few_texts_at_a_time(spark):
    """A batch's texts are handed over in slices of bounded size; no span is lost."""
    from divspark.operators import generate as G

    def spans(texts):
        assert sum(map(len, texts)) <= G.SPAN_CHARS or len(texts) == 1
        return [None if not t else [*t.split()[:2], None] for t in texts]
    rows = [("r", k % 3, f"Word{k} " + "x " * 30_000) for k in range(60)] + [("r", None, None), (None, 1, ""), ("r", 2, "Y" * (G.SPAN_CHARS + 5))]
    df = spark.createDataFrame(rows, "run string, label int, seed string").coalesce(1)
    got = sorted((r["run"], r["label"], r["span"]) for r in G.entity_spans(df, spans, ["run"]).collect())
    want = [(run, label, s) for run, label, t in rows if t for s in t.lower().split()[:2]]
    assert got == sorted(want)
