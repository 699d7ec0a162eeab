from pyspark.sql import functions as F

from divspark.functions import answers as A
from divspark.functions import prompts as P


def _val(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("y")).first()["y"]


def test_plain_and_taboo(spark):
    assert _val(spark, P.plain_prompt("s"), [("hi 100%",)], "s string") == \
        'Rephrase an original question or statement 3 times. Original phrase: "hi 100%".'
    got = _val(spark, P.taboo_prompt("s", "w"), [("x", ["a", "b", "c"])], "s string, w array<string>")
    assert got == ('Rephrase an original question or statement 3 times. Original phrase: "x". '
                   'Don’t use the words “a”, “b” or “c” in your responses.')
    two = _val(spark, P.taboo_prompt("s", "w"), [("x", ["a", "b"])], "s string, w array<string>")
    assert two.endswith("Don’t use the words “a” or “b” in your responses.")
    none = _val(spark, P.taboo_prompt("s", "w"), [("x", [])], "s string, w array<string>")
    assert none == 'Rephrase an original question or statement 3 times. Original phrase: "x".'


def test_hint_prompts(spark):
    got = _val(spark, P.hint_prompt("s", "h"), [("x", ["h1", "h2"])], "s string, h array<string>")
    assert got == ('Rephrase an original question or statement 3 times. Original phrase: "x".\n'
                   '    Example paraphrases:\n    "h1".\n"h2".\n    ')
    gpt = _val(spark, P.hint_prompt("s", "h", P.HINT_TEMPLATE_GPT_TOP), [("x", ["h1"])], "s string, h array<string>")
    assert gpt.endswith('###\nExample paraphrases:\n"h1".\n###\n')


def test_llama_chat_rendering(spark):
    schema = "m array<struct<role:string,content:string>>"
    one = _val(spark, P.llama_chat("m"), [([("user", " hi ")],)], schema)
    # the system text is folded in before the strip, so the user turn keeps its leading space
    assert one == f"[INST] <<SYS>>\n{P.SYSTEM_PROMPT}\n<</SYS>>\n\n hi [/INST]"
    conv = [("system", "S"), ("user", "u1"), ("assistant", " a1 "), ("user", "u2")]
    got = _val(spark, P.llama_chat("m"), [(conv,)], schema)
    assert got == "[INST] <<SYS>>\nS\n<</SYS>>\n\nu1 [/INST] a1[INST] u2 [/INST]"
    # ends with an assistant turn: it closes a pair and is appended again, as the reference does
    conv2 = [("user", "u1"), ("assistant", "a1")]
    got2 = _val(spark, P.llama_chat("m"), [(conv2,)], schema)
    assert got2 == f"[INST] <<SYS>>\n{P.SYSTEM_PROMPT}\n<</SYS>>\n\nu1 [/INST] a1[INST] a1 [/INST]"


def test_platypus_gpt_sft(spark):
    assert _val(spark, P.platypus_prompt("s"), [("q",)], "s string") == \
        "### Instruction:\n\n    q\n\n    ### Response:\n    "
    msgs = _val(spark, P.gpt_messages("s"), [("q",)], "s string")
    assert [(m["role"], m["content"]) for m in msgs] == [("system", P.SYSTEM_PROMPT), ("user", "q")]
    s = _val(spark, P.sft_sample("t", "l", "sst5"), [("good", 3)], "t string, l int")
    assert s == ('The conversation between Human and AI assistant. [INST] Text: "good". Question: Is this text '
                 '"very negative", "negative", "neutral", "positive" or "very positive"? [\\INST] Answer: positive')
    i = _val(spark, P.sft_inference_sample("t", "sst5"), [("good",)], "t string")
    assert i.endswith("[\\INST]")


def test_answer_parsing(spark):
    df = spark.createDataFrame([("x [\\INST] Answer: very positive.",), ("x [\\INST] Answer: Flight!",),
                                ("x [\\INST] Answer:",), ("no marker at all",), (None,)], "t string")
    ids = {"very positive": 4, "Flight": 5}
    got = df.select(A.parse_answer(A.text_after_marker("t")).alias("a")).withColumn(
        "id", A.answer_label("a", ids)).collect()
    assert [(r["a"], r["id"]) for r in got] == [("very positive", 4), (None, 0), (None, 0), ("at", 0), (None, 0)]
