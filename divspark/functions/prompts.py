"""Prompt rendering as column expressions (B-1 .. B-9).

Templates use ``{}`` slots like ``str.format``; :func:`fill` turns one into a
``concat`` of literals and columns (no ``%`` escaping issues, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from divspark.functions.text import py_strip

# ---------------------------------------------------------------------------
# Prompt texts and label names, as the collection and training
# scripts write them.  Indentation inside a template is part of the prompt.
# ---------------------------------------------------------------------------
PLAIN_TEMPLATE = 'Rephrase an original question or statement 3 times. Original phrase: "{}".'
TABOO_TEMPLATE = ('Rephrase an original question or statement 3 times. Original phrase: "{}". '
                  'Don’t use the words “{}”, “{}” or “{}” in your responses.')
HINT_TEMPLATE_LOCAL = ('Rephrase an original question or statement 3 times. Original phrase: "{}".\n'
                       '    Example paraphrases:\n    {}\n    ')
HINT_TEMPLATE_GPT = ('Rephrase an original question or statement 3 times. Original phrase: "{}".\n'
                     '    ###\n    Example paraphrases:\n    {}\n    ###\n    ')
HINT_TEMPLATE_GPT_TOP = ('Rephrase an original question or statement 3 times. Original phrase: "{}".\n'
                         '###\nExample paraphrases:\n{}\n###\n')
HINT_ITEM = '"{}".'
SYSTEM_PROMPT = "You are a crowdsourcing worker that earns a living through creating paraphrases."
LLAMA_B_INST, LLAMA_E_INST = "[INST]", "[/INST]"
LLAMA_B_SYS, LLAMA_E_SYS = "<<SYS>>\n", "\n<</SYS>>\n\n"
PLATYPUS_TEMPLATE = "### Instruction:\n\n    {}\n\n    ### Response:\n    "
SFT_TEMPLATE = "The conversation between Human and AI assistant. [INST] {} [\\INST] {}"
SFT_INFER_TEMPLATE = "The conversation between Human and AI assistant. [INST] {} [\\INST]"
SFT_ANSWER_TEMPLATE = "Answer: {}"
SFT_QUESTIONS = {
    "atis": 'Text: "{}". Question: What is the intent of this text based on options: "Abbreviation", "Aircraft", "Airfare", "Airline", "Time", "Flight", "Quantity", "Ground Service"?',
    "fb": 'Text: "{}". Question: What is the intent of this text based on options: "Directions", "Distance", "Arrival", "Departure", "Duration", "Road Condition", "Route", "Traffic", "Location", "Update"?',
    "yelp": 'Text: "{}". Question: How many stars does this text have based on options: "one star", "two stars", "three stars", "four stars", "five stars"?',
    "20news": 'Text: "{}". Question: What is the category of this news text based on options: "Entertainment", "Parenting", "Politics", "Style and Beauty", "Travel", "Wellness"?',
    "ag_news": 'Text: "{}". Question: What is the category of this news text based on options: "World", "Sports", "Business", "Science and Technology"?',
    "sst5": 'Text: "{}". Question: Is this text "very negative", "negative", "neutral", "positive" or "very positive"?',
}
SFT_LABELS = {
    "atis": ["Abbreviation", "Aircraft", "Airfare", "Airline", "Time", "Flight", "Quantity", "Ground Service"],
    "fb": ["Directions", "Distance", "Arrival", "Departure", "Duration", "Road Condition", "Route", "Traffic",
           "Location", "Update"],
    "yelp": ["one star", "two stars", "three stars", "four stars", "five stars"],
    "20news": ["Entertainment", "Parenting", "Politics", "Style and Beauty", "Travel", "Wellness"],
    "ag_news": ["World", "Sports", "Business", "Science and Technology"],
    "sst5": ["very negative", "negative", "neutral", "positive", "very positive"],
}
# Intent names of the fb assembly notebook (the 9-entry map its label function uses).
FB_INTENT_IDS = {"get_directions": 0, "get_distance": 1, "get_estimated_arrival": 2,
                 "get_estimated_departure": 3, "get_estimated_duration": 4, "get_event": 5,
                 "get_info_road_condition": 6, "get_info_traffic": 7, "update_directions": 8}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, *values) -> Column:
    """``template.format(*values)`` as a ``concat`` of literal pieces and columns."""
    pieces = template.split("{}")
    if len(pieces) - 1 != len(values):
        raise ValueError(f"template has {len(pieces) - 1} slots, got {len(values)} values")
    parts: list[Column] = []
    for i, p in enumerate(pieces):
        if p:
            parts.append(F.lit(p))
        if i < len(values):
            parts.append(_col(values[i]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def plain_prompt(seed) -> Column:
    """B-1."""
    return fill(PLAIN_TEMPLATE, seed)


def taboo_prompt(seed, words) -> Column:
    """B-2: taboo words in ascending coefficient order.

    With three words this is the reference template; with fewer (the reference
    fails) the list has as many words as exist, and none drops the sentence.
    """
    w = _col(words)
    n = F.size(w)
    quoted = F.transform(w, lambda x: F.concat(F.lit("“"), x, F.lit("”")))
    fewer = F.when(n == 1, quoted[0]).when(
        n == 2, F.concat(quoted[0], F.lit(" or "), quoted[1]))
    three = fill(TABOO_TEMPLATE, seed, w[0], w[1], w[2])
    return (F.when(n >= 3, three)
            .when(n >= 1, F.concat(plain_prompt(seed), F.lit(" Don’t use the words "), fewer,
                                   F.lit(" in your responses.")))
            .otherwise(plain_prompt(seed)))


def hint_block(hints) -> Column:
    """B-3/B-4 hint list: ``"\\n".join('"{}".'.format(h) for h in hints)``."""
    return F.array_join(F.transform(_col(hints), lambda h: fill(HINT_ITEM, h)), "\n")


def hint_prompt(seed, hints, template: str = HINT_TEMPLATE_LOCAL) -> Column:
    """B-3 (local models) / B-4 (``HINT_TEMPLATE_GPT`` or ``HINT_TEMPLATE_GPT_TOP``)."""
    return fill(template, seed, hint_block(hints))


def platypus_prompt(prompt) -> Column:
    """B-6."""
    return fill(PLATYPUS_TEMPLATE, prompt)


def gpt_messages(prompt, system: str = SYSTEM_PROMPT) -> Column:
    """B-7: ``[{role: system, ...}, {role: user, content: prompt}]``."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), _col(prompt).cast("string").alias("content")))


def llama_chat(messages, system: str = SYSTEM_PROMPT) -> Column:
    """B-5 ``llama_v2_prompt`` over ``array<struct<role, content>>`` in turn order.

    A default system turn is added when the first is not a system turn; the
    system text is folded into the next turn; turns pair up as
    ``[INST] p [/INST] a`` by position (roles are not checked) and the last
    turn is appended as an open ``[INST] x [/INST]``.
    """
    m = _col(messages)
    has_sys = m[0]["role"] == F.lit("system")
    default = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    msgs = F.when(has_sys, m).otherwise(F.concat(default, m))
    first = F.struct(msgs[1]["role"].alias("role"),
                     F.concat(F.lit(LLAMA_B_SYS), msgs[0]["content"], F.lit(LLAMA_E_SYS),
                              msgs[1]["content"]).alias("content"))
    folded = F.concat(F.array(first), F.filter(msgs, lambda x, i: i >= 2))
    n = F.size(folded)
    pairs = F.transform(folded, lambda x, i: F.when(
        (i % 2 == 0) & (i + 1 < n),
        F.concat(F.lit(LLAMA_B_INST + " "), py_strip(x["content"]), F.lit(" " + LLAMA_E_INST + " "),
                 py_strip(F.element_at(folded, i + 2)["content"]))))
    body = F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "")
    last = F.element_at(folded, -1)["content"]
    return F.concat(body, F.lit(LLAMA_B_INST + " "), py_strip(last), F.lit(" " + LLAMA_E_INST))


def label_name(label, dataset: str) -> Column:
    names = SFT_LABELS[dataset]
    return F.element_at(F.array(*[F.lit(x) for x in names]), _col(label).cast("int") + 1)


def sft_sample(text, label, dataset: str) -> Column:
    """B-8 training sample: question with the text, answer with the label name."""
    return fill(SFT_TEMPLATE, fill(SFT_QUESTIONS[dataset], text),
                fill(SFT_ANSWER_TEMPLATE, label_name(label, dataset)))


def sft_inference_sample(text, dataset: str) -> Column:
    """B-9 inference sample (no answer)."""
    return fill(SFT_INFER_TEMPLATE, fill(SFT_QUESTIONS[dataset], text))
