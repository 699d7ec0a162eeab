import pytest

from divspark.operators.parse import parse_responses
from tests.conftest import rows


def _parse(spark, profile, responses, seed="s", label=0):
    df = spark.createDataFrame([(label, seed, r) for r in responses], "label int, seed string, response string")
    return {r[0] for r in rows(parse_responses(df, profile), "text")}


def test_llama_drops_first_line_and_numbered_refusals(spark):
    r = "[INST] p [/INST] Sure, here are three:\n1. Paraphrase one\n2. paraphrased b\n  \nplain paraphrase line\n10. x"
    # numbered 'paraphr' skipped (case-sensitive: 'Paraphrase' kept), unnumbered kept,
    # '10. x' loses three characters
    assert _parse(spark, "llama", [r]) == {"paraphrase one", "plain paraphrase line", "x"[0:0] or " x".strip()}


def test_mistral_refusal_on_every_line_and_inst_removed(spark):
    r = "[INST] p [/INST]\nintro\n1. an instant reply\nparaphrased text\n3. Inst ok"
    assert _parse(spark, "mistral", [r]) == {"an ant reply", "inst ok"}


def test_missing_marker(spark):
    # llama: find = -1 drops the first 6 characters; platypus keeps only the last character
    assert _parse(spark, "llama", ["abcdefFIRST\nsecond"]) == {"second"}
    assert _parse(spark, "platypus", ["no marker here\nline"]) == set()


def test_platypus_variants(spark):
    r = "### Instruction:\n\n    q\n\n    ### Response:\n    1. One!\n    paraphrase: two\n"
    assert _parse(spark, "platypus", [r]) == {"one", "paraphrase two"}
    assert _parse(spark, "platypus_filtered", [r]) == {"one"}


def test_gpt_keeps_first_line_and_space_lines(spark):
    r = '1. "Quoted" first\n\n   \n2. it’s “curly”\nnull'
    assert _parse(spark, "gpt", [r]) == {"quoted first", "   ", "it’s “curly”", "null"}


def test_only_punctuation_and_duplicates_dropped(spark):
    r = "[INST] p [/INST] head\n1. ?!\n2. Same.\n3. same"
    df_rows = _parse(spark, "llama", [r, r])
    assert df_rows == {"same"}


def test_array_response_reads_first_sequence(spark):
    df = spark.createDataFrame([(0, "s", ["[INST] [/INST] h\n1. a b", "[INST] [/INST] h\n1. other"])],
                               "label int, seed string, response array<string>")
    assert rows(parse_responses(df, "llama"), "text") == [("a b",)]


def test_unknown_profile(spark):
    df = spark.createDataFrame([(0, "s", "x")], "label int, seed string, response string")
    with pytest.raises(KeyError):
        parse_responses(df, "nope")


def test_inst_removal_switch(spark):
    df = spark.createDataFrame([(0, "s", "[INST] p [/INST]\nintro\n1. an instant reply")],
                               "label int, seed string, response string")
    assert [r[0] for r in parse_responses(df, "mistral").select("text").collect()] == ["an ant reply"]
    plain = parse_responses(df, "mistral", remove_inst=False)
    assert [r[0] for r in plain.select("text").collect()] == ["an instant reply"]
