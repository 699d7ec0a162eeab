from divspark.operators.assembly import assemble, first_wins, ordered_union
from tests.conftest import rows


def test_first_wins_precedence(spark):
    r0 = spark.createDataFrame([("r", 1, "same", "s1"), ("r", 1, "only0", "s1")],
                               "run string, label int, text string, seed string")
    mr = spark.createDataFrame([("r", "taboo", 2, "same", "s2"), ("r", "taboo", 2, 'say "hi"', "s2"),
                                ("r", "taboo", 2, "a paraphrase of", "s2"), ("r", "taboo", 2, None, "s2"),
                                ("r", "prompt", 3, "plain paraphrase", None)],
                               "run string, method string, label int, text string, seed string")
    sd = spark.createDataFrame([("r", "same", 9), ("r", "say hi", 9), ("r", "seedonly", 9)],
                               "run string, text string, label int")
    got = rows(assemble(r0, mr, sd, ["run"]), "method", "text", "label")
    assert ("taboo", "same", 1) in got                     # round 0 wins over the method round and seeds
    assert ("taboo", "say hi", 2) in got and ("taboo", "say hi", 9) in got   # dequote after dedup: both kept
    assert not any("paraphrase of" in t for m, t, _ in got)                  # refusal filtered in the method round
    assert all(t is not None for _, t, _ in got)
    # the plain method is not filtered, and drops rows with any null (seed is null here)
    assert not any(m == "prompt" and t == "plain paraphrase" for m, t, _ in got)
    assert {m for m, _, _ in got} == {"taboo"}


def test_tie_between_labels_follows_the_salt(spark):
    parts = [spark.createDataFrame([("k", f"t{i}", lab, "s") for i in range(50) for lab in (0, 1)],
                                   "run string, text string, label int, seed string")]
    for salt in ("1", "2"):
        got = [r["label"] for r in first_wins(ordered_union(parts), ["run"], salt=salt).collect()]
        assert len(got) == 50 and 10 < sum(got) < 40


def test_a_method_of_refusals_keeps_its_training_set(spark):
    r0 = spark.createDataFrame([("r", 1, "zero", "s")], "run string, label int, text string, seed string")
    mr = spark.createDataFrame([("r", "taboo", 2, "a paraphrase", "s"), ("r", "hints", 2, "good", "s")],
                               "run string, method string, label int, text string, seed string")
    sd = spark.createDataFrame([("r", "seed", 3)], "run string, text string, label int")
    assert rows(assemble(r0, mr, sd, ["run"]), "method", "text") == [
        ("hints", "good"), ("hints", "seed"), ("hints", "zero"), ("taboo", "seed"), ("taboo", "zero")]


def test_filter_scope_all(spark):
    r0 = spark.createDataFrame([("r", 1, "paraphrased zero", "s")], "run string, label int, text string, seed string")
    mr = spark.createDataFrame([("r", "hints", 2, "x", "s")], "run string, method string, label int, text string, seed string")
    sd = spark.createDataFrame([("r", "y", 3)], "run string, text string, label int")
    got = rows(assemble(r0, mr, sd, ["run"], filter_scope="all"), "text")
    assert got == [("x",), ("y",)]
    kept = rows(assemble(r0, mr, sd, ["run"], filter_scope="method"), "text")
    assert ("paraphrased zero",) in kept


def test_first_wins_hot_text(spark):
    parts = [spark.createDataFrame([("k", f"t{i % 2}", i) for i in range(200)], "run string, text string, label int")
             for _ in range(3)]
    got = first_wins(ordered_union(parts), ["run"], carry=("label",))
    assert got.count() == 2 and {r["priority"] for r in got.collect()} == {0}


def test_assemble_without_keys(spark):
    r0 = spark.createDataFrame([(1, "a", "s")], "label int, text string, seed string")
    mr = spark.createDataFrame([("hints", 2, "b", "s")], "method string, label int, text string, seed string")
    sd = spark.createDataFrame([("a", 3)], "text string, label int")
    assert rows(assemble(r0, mr, sd, []), "method", "text", "label") == [("hints", "a", 1), ("hints", "b", 2)]
