from pyspark.sql import functions as F

from divspark.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_clean_text_python_semantics(spark):
    # lower, strip (Unicode whitespace), dequote, ASCII punctuation only
    assert _one(spark, T.clean_text("x"), '  "Hello," World! 　') == "hello world"
    assert _one(spark, T.clean_text("x"), "“curly” it’s, it's") == "“curly” it’s its"
    assert _one(spark, T.clean_text("x"), "?!.,") is None          # empty after clean -> null
    assert _one(spark, T.clean_text("x"), "null") == "null"        # the word stays (reader option)
    assert _one(spark, T.clean_text("x"), " a. ") == "a"
    # no re-strip after punctuation removal
    assert _one(spark, T.clean_text("x"), "a .") == "a "


def test_strip_matches_python(spark):
    s = "\t\x0b\x1c x y \x85 "
    assert _one(spark, T.py_strip("x"), s) == s.strip()


def test_whitespace_tokens_no_empty_edges(spark):
    assert _one(spark, T.whitespace_tokens("x"), "  a\tb\n c  ") == ["a", "b", "c"]
    assert _one(spark, T.whitespace_tokens("x"), "   ") == []


def test_stop_words_case_sensitive(spark):
    got = _one(spark, T.remove_stop_words("x"), "The cat and the hat")
    assert got == ["The", "cat", "hat"]
    assert "the" in T.default_stop_words() and len(T.default_stop_words()) > 100


def test_word_tokens_count_vectorizer(spark):
    assert _one(spark, T.word_tokens("x"), "A bc, Déjà-vu x_1 9 42") == ["bc", "déjà", "vu", "x_1", "42"]


def test_words_and_digits_as_in_python(spark):
    import re
    texts = ["x² हिन्दी भाषा cafe\u0301s", "①② Ⅷ ½ a_b _ __ 9", "naïve Ünï 漢字 ab", "e\u0301e\u0301 ٣٤ x\u200dy"]
    for t in texts:
        assert _one(spark, T.word_tokens("x"), t) == re.findall(r"(?u)\b\w\w+\b", t.lower())
    for w in ["²", "①", "12³", "½", "Ⅷ", "٣", "x2", "12"]:
        assert _one(spark, T.is_digit_word("x"), w) == w.isdigit(), w


def test_is_digit_and_order_key(spark):
    df = spark.createDataFrame([("123",), ("12a",), ("٣",)], "x string")
    assert [r[0] for r in df.select(T.is_digit_word("x")).collect()] == [True, False, True]
    import hashlib
    assert _one(spark, T.order_key("x", "s"), "abc") == hashlib.md5(b"s:abc").hexdigest()


def test_whitespace_tokens_take_every_white_space(spark):
    from divspark.functions.text import PY_WHITESPACE, whitespace_tokens

    texts = [f"a{c}b{c}{c}é{c}" for c in PY_WHITESPACE] + [PY_WHITESPACE, "", " x ", None, "​⁠y z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", whitespace_tokens("t").alias("w")).collect()}
    assert got == {i: None if t is None else t.split() for i, t in enumerate(texts)}
    # a regex a text: what made the vocabulary queries slow
    assert "x{" not in df.select(whitespace_tokens("t"))._jdf.queryExecution().toString()
