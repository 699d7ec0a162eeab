"""Response parsing, answer reading and prompt rendering queries on
``conversations`` / ``documents`` (P-1 .. P-5, M-4 .. M-6, B-1 .. B-9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from divspark.functions import answers as A
from divspark.functions import prompts as P
from divspark.operators.parse import parse_responses
from divspark.operators.sampling import stratified_sample
from divspark.plans import sqlbits as Q
from divspark.plans.registry import register
from divspark.sources.tables import read_table

NL = "chr(10)"


def exchanges(spark, sf):
    """Stand-in responses: every assistant turn that follows a user turn; the
    user text is the seed, ``label = conv_id % 8``."""
    c = read_table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = (c.withColumn("seed", F.lag("text").over(w)).withColumn("prev_role", F.lag("role").over(w))
         .where((F.col("role") == "assistant") & (F.col("prev_role") == "user")))
    return c.select("conv_id", "turn", (F.col("conv_id") % 8).cast("int").alias("label"), "seed",
                    F.col("text").alias("answer"))


_EXCHANGES_SQL = """
ex AS (SELECT conv_id, turn, CAST(conv_id % 8 AS INTEGER) AS label, seed, text AS answer FROM (
  SELECT conv_id, turn, role, text, lag(text) OVER w AS seed, lag(role) OVER w AS prev_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND prev_role = 'user')"""

# How each profile's raw response looks: the decoded prompt followed by the answer.
_LLAMA_RESPONSE = "[INST] {} [/INST] {}"
_PLATYPUS_RESPONSE = P.PLATYPUS_TEMPLATE + "{}"


def _response_col(profile):
    if profile == "gpt":
        return F.col("answer")
    if profile in ("llama", "mistral"):
        return P.fill(_LLAMA_RESPONSE, "seed", "answer")
    return P.fill(_PLATYPUS_RESPONSE, "seed", "answer")


def _response_sql(profile):
    if profile == "gpt":
        return "answer"
    if profile in ("llama", "mistral"):
        return "'[INST] ' || seed || ' [/INST] ' || answer"
    return f"'### Instruction:' || {NL} || {NL} || '    ' || seed || {NL} || {NL} || '    ### Response:' || {NL} || '    ' || answer"


def _parse_sql(profile, response_sql=None):
    resp = response_sql or _response_sql(profile)
    after_llama = "substr(response, instr(response, '[/INST]') + 7)"
    from_platypus = ("CASE WHEN instr(response, 'Response:') > 0 THEN substr(response, instr(response, 'Response:')) "
                     "ELSE right(response, 1) END")
    if profile == "gpt":
        lines = f"string_split(response, {NL})"
    elif profile in ("llama", "mistral"):
        lines = f"string_split({Q.strip(after_llama)}, {NL})[2:]"
    elif profile == "platypus":
        lines = f"string_split({from_platypus}, {NL})[2:]"
    else:
        lines = f"string_split({Q.strip(from_platypus)}, {NL})[2:]"
    c = "line" if profile == "gpt" else Q.strip("line")
    keep = "length(c) > 0"
    if profile in ("mistral", "platypus_filtered"):
        keep += " AND NOT contains(cut, 'paraphr')"
    elif profile == "llama":
        keep += " AND NOT (numbered AND contains(cut, 'paraphr'))"
    cut = "replace(cut, 'inst', '')" if profile == "mistral" else "cut"
    clean = Q.clean(cut, do_strip=(profile != "gpt"))
    return f"""
WITH {_EXCHANGES_SQL},
r AS (SELECT label, seed, {resp} AS response FROM ex),
l AS (SELECT label, seed, unnest({lines}) AS line FROM r),
c1 AS (SELECT label, seed, {c} AS c FROM l),
c2 AS (SELECT label, seed, c, left(c, 1) IN ('1', '2', '3') AS numbered FROM c1),
c3 AS (SELECT label, seed, c, numbered, CASE WHEN numbered THEN substr(c, 4) ELSE c END AS cut FROM c2)
SELECT DISTINCT label, seed, text FROM (
  SELECT label, seed, {clean} AS text FROM c3 WHERE {keep}) WHERE text IS NOT NULL"""


def _make_parse(profile):
    def q(spark, sf):
        ex = exchanges(spark, sf).withColumn("response", _response_col(profile))
        return parse_responses(ex, profile).select("label", "seed", "text")
    q.__doc__ = f"P-{list(('gpt', 'llama', 'mistral', 'platypus', 'platypus_filtered')).index(profile) + 1}: parse {profile} responses."
    return q


for _p in ("gpt", "llama", "mistral", "platypus", "platypus_filtered"):
    register(f"parse_{_p}", _parse_sql(_p))(_make_parse(_p))


# Numbered answers: every assistant turn's sentences as "k. sentence" lines (k = 1, 2, 3, 1, ...)
# under a header line, wrapped in each profile's response format.
_HEADER = "Here are the paraphrases:"


def _numbered_col():
    from divspark.functions.text import py_strip
    sents = F.filter(F.transform(F.split(F.regexp_replace("answer", "\n", " "), "\\. "), lambda x: py_strip(x)),
                     lambda x: x != F.lit(""))
    lines = F.transform(sents, lambda x, i: F.concat(((i % 3) + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.lit(_HEADER + "\n"), F.array_join(lines, "\n"))


def _numbered_sql():
    strip = Q.strip("x")
    return (f"{Q.lit(_HEADER)} || {NL} || array_to_string(list_transform(list_filter(list_transform("
            f"string_split(replace(answer, {NL}, ' '), '. '), lambda x: {strip}), lambda x: x <> ''), "
            f"lambda x, i: CAST((i - 1) % 3 + 1 AS VARCHAR) || '. ' || x), {NL})")


def _numbered_response_sql(profile):
    body = _numbered_sql()
    if profile == "gpt":
        return body
    if profile in ("llama", "mistral"):
        return f"'[INST] ' || seed || ' [/INST] ' || {body}"
    return (f"'### Instruction:' || {NL} || {NL} || '    ' || seed || {NL} || {NL} || '    ### Response:' || {NL}"
            f" || '    ' || {body}")


def _make_numbered(profile):
    def q(spark, sf):
        ex = exchanges(spark, sf).withColumn("answer", _numbered_col())
        ex = ex.withColumn("response", _response_col(profile))
        return parse_responses(ex, profile).select("label", "seed", "text")
    q.__doc__ = f"P-1 .. P-5 on numbered answers ({profile}): numbering cut, header line, per-line strip."
    return q


for _p in ("gpt", "llama", "mistral", "platypus", "platypus_filtered"):
    register(f"parse_numbered_{_p}", _parse_sql(_p, _numbered_response_sql(_p)))(_make_numbered(_p))


_REPLY_SQL = Q.strip("substr(chat, instr(chat, '[\\INST]') + 7)")
_FB_IDS = {name: i for i, name in enumerate(P.SFT_LABELS["fb"])}
_FB_CASE = " ".join(f"WHEN {Q.lit(k)} THEN {v}" for k, v in _FB_IDS.items())


def _drop_last_sql(w):
    return f"CASE WHEN regexp_full_match(right({w}, 1), '\\p{{L}}') THEN {w} ELSE substr({w}, 1, length({w}) - 1) END"


@register("answer_labels", f"""
WITH {_EXCHANGES_SQL},
s AS (SELECT conv_id, turn, {Q.lit(P.SFT_INFER_TEMPLATE.split('{}')[0])} || {Q.lit(P.SFT_QUESTIONS['fb'].split('{}')[0])}
             || seed || {Q.lit(P.SFT_QUESTIONS['fb'].split('{}')[1])} || {Q.lit(P.SFT_INFER_TEMPLATE.split('{}')[1])}
             || ' ' || answer AS chat FROM ex),
a AS (SELECT conv_id, turn, {_REPLY_SQL} AS reply FROM s),
w AS (SELECT conv_id, turn, reply, {Q.ws_tokens('reply')} AS words FROM a),
p AS (SELECT conv_id, turn, reply, CASE WHEN len(words) >= 3 THEN
        CASE WHEN {_drop_last_sql('words[3]')} IN ('positive', 'negative')
             THEN {_drop_last_sql('words[2]')} || ' ' || {_drop_last_sql('words[3]')}
             ELSE {_drop_last_sql('words[2]')} END END AS answer FROM w)
SELECT conv_id, turn, md5(reply) AS reply_md5, answer,
       CAST(CASE answer {_FB_CASE} ELSE 0 END AS INTEGER) AS label_id,
       (CASE answer {_FB_CASE} END) IS NULL AS is_unknown
FROM p""")
def answer_labels(spark, sf):
    """M-4 .. M-6 on SFT inference samples (B-9) followed by the assistant turn:
    text after ``[\\INST]``, words 2-3 as the answer, answer -> fb label id."""
    ex = exchanges(spark, sf)
    chat = F.concat(P.sft_inference_sample("seed", "fb"), F.lit(" "), F.col("answer"))
    reply = A.text_after_marker(chat)
    ans = A.parse_answer(reply)
    return ex.select("conv_id", "turn", F.md5(reply).alias("reply_md5"), ans.alias("answer"),
                     A.answer_label(ans, _FB_IDS).alias("label_id"),
                     A.answer_is_unknown(ans, _FB_IDS).alias("is_unknown"))


@register("prompts_plain", f"""
SELECT source, lang, doc_id, {Q.lit(P.PLAIN_TEMPLATE.split('{}')[0])} || text || {Q.lit(P.PLAIN_TEMPLATE.split('{}')[1])} AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {Q.order_key('text', 'seed', 'source', 'lang')}, text, doc_id) AS rank
      FROM documents) WHERE rank <= 6""")
def prompts_plain(spark, sf):
    """B-1 over the F-1 seed sample (six per label and run)."""
    s = stratified_sample(read_table(spark, sf, "documents"), ["source"], 6, label="lang", salt="seed",
                          tie=["doc_id"])
    return s.select("source", "lang", "doc_id", P.plain_prompt("text").alias("prompt"))


_CHAT_SQL = f"""
WITH m AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS msgs
           FROM conversations GROUP BY conv_id),
m2 AS (SELECT conv_id, CASE WHEN msgs[1].role = 'system' THEN msgs
                            ELSE list_concat([struct_pack(role := 'system', content := {Q.lit(P.SYSTEM_PROMPT)})], msgs) END AS msgs
       FROM m),
f AS (SELECT conv_id, list_concat([struct_pack(role := msgs[2].role,
              content := '<<SYS>>' || {NL} || msgs[1].content || {NL} || '<</SYS>>' || {NL} || {NL} || msgs[2].content)],
              msgs[3:]) AS f FROM m2)
SELECT conv_id,
  array_to_string(list_filter(list_transform(f, lambda x, i: CASE WHEN i % 2 = 1 AND i < len(f)
      THEN '[INST] ' || {Q.strip('x.content')} || ' [/INST] ' || {Q.strip('f[i + 1].content')} END),
      lambda p: p IS NOT NULL), '')
  || '[INST] ' || {Q.strip('f[len(f)].content')} || ' [/INST]' AS prompt
FROM f"""


@register("chat_llama", _CHAT_SQL)
def chat_llama(spark, sf):
    """B-5: each conversation rendered in the Llama 2 chat format.

    The rendering of a conversation is one string, so its turns are gathered
    in one group; a conversation is bounded by the model's context length.
    """
    c = read_table(spark, sf, "conversations")
    msgs = (c.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda s: F.struct(s["role"].alias("role"),
                                                                    s["content"].alias("content"))).alias("msgs")))
    return msgs.select("conv_id", P.llama_chat("msgs").alias("prompt"))


@register("prompts_platypus", f"""
SELECT conv_id, turn, '### Instruction:' || {NL} || {NL} || '    ' || {Q.lit(P.PLAIN_TEMPLATE.split('{}')[0])} || text
       || {Q.lit(P.PLAIN_TEMPLATE.split('{}')[1])} || {NL} || {NL} || '    ### Response:' || {NL} || '    ' AS prompt
FROM conversations WHERE role = 'user'""")
def prompts_platypus(spark, sf):
    """B-6: plain prompt of every user turn in the Platypus instruction format."""
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", P.platypus_prompt(P.plain_prompt("text")).alias("prompt"))


@register("gpt_messages", f"""
SELECT conv_id, turn, 0 AS msg_idx, 'system' AS role, {Q.lit(P.SYSTEM_PROMPT)} AS content
FROM conversations WHERE role = 'user'
UNION ALL
SELECT conv_id, turn, 1 AS msg_idx, 'user' AS role, text AS content FROM conversations WHERE role = 'user'""")
def gpt_messages(spark, sf):
    """B-7: the hosted model's two-message request for every user turn."""
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    m = c.select("conv_id", "turn", F.posexplode(P.gpt_messages("text")).alias("msg_idx", "m"))
    return m.select("conv_id", "turn", "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _sft_sql(name_expr):
    q0, q1 = P.SFT_QUESTIONS["fb"].split("{}")
    t0, t1, t2 = P.SFT_TEMPLATE.split("{}")
    return (f"{Q.lit(t0)} || {Q.lit(q0)} || d.text || {Q.lit(q1)} || {Q.lit(t1)} || 'Answer: ' || {name_expr}"
            f" || {Q.lit(t2)}")


_FB_NAMES = "[" + ", ".join(Q.lit(x) for x in P.SFT_LABELS["fb"]) + "]"


@register("sft_samples", f"""
SELECT d.doc_id, {_sft_sql(f'{_FB_NAMES}[CAST(d.doc_id % 10 AS INTEGER) + 1]')} AS sample,
       {Q.lit(P.SFT_INFER_TEMPLATE.split('{}')[0])} || {Q.lit(P.SFT_QUESTIONS['fb'].split('{}')[0])} || d.text
       || {Q.lit(P.SFT_QUESTIONS['fb'].split('{}')[1])} || {Q.lit(P.SFT_INFER_TEMPLATE.split('{}')[1])} AS inference_sample
FROM documents d""")
def sft_samples(spark, sf):
    """B-8 / B-9: fine-tuning and inference samples (fb label names, labels 0-9)."""
    j = read_table(spark, sf, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(10)).cast("int").alias("label"))
    return j.select("doc_id", P.sft_sample("text", "label", "fb").alias("sample"),
                    P.sft_inference_sample("text", "fb").alias("inference_sample"))
