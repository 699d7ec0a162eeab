import pytest
from pyspark.sql import functions as F

from divspark.functions import prompts as P
from divspark.operators import filters as FL
from divspark.operators.ranking import top_k
from divspark.operators.sampling import sample_fraction
from tests.conftest import rows


def test_map_labels_strict_and_lenient(spark):
    df = spark.createDataFrame([("get_event",), ("get_distance",), (None,)], "intent string")
    got = rows(FL.map_labels(df, P.FB_INTENT_IDS, "intent"), "intent", "label")
    assert set(got) == {(None, None), ("get_distance", 1), ("get_event", 5)}
    bad = spark.createDataFrame([("nope",)], "intent string")
    with pytest.raises(Exception):
        FL.map_labels(bad, P.FB_INTENT_IDS, "intent").collect()
    assert FL.map_labels(bad, P.FB_INTENT_IDS, "intent", strict=False).first()["label"] is None


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("x paraphrased", 3), ("Paraphrase", 4)],
                               "text string, label int")
    assert FL.distinct_rows(df).count() == 4
    assert FL.drop_nulls(df, ["text"]).count() == 4
    assert rows(FL.drop_refusals(df), "label") == [(1,), (1,), (4,)]
    assert rows(FL.one_vs_rest(df, 1), "label", "y")[0] == (1, 1)
    seeds = spark.createDataFrame([("s1", 0), ("s1", 0)], "seed string, label int")
    assert rows(FL.normalise_seeds(seeds, []), "text", "label") == [("s1", 0)]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g string, text string, k int")
    assert top_k(empty, ["g"], [F.col("text").asc()], "k").count() == 0
    assert sample_fraction(empty.drop("k"), ["g"], 0.5).count() == 0


def test_taboo_prompt_null_words(spark):
    df = spark.createDataFrame([("x", None)], "s string, w array<string>")
    assert df.select(P.taboo_prompt("s", "w")).first()[0] == P.PLAIN_TEMPLATE.format("x")
