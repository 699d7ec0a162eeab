"""Source/sink and model-hook queries (S-1 .. S-5, R-1 .. R-3, K-1).

The write/read queries store the driver's table in the shared checkpoint
folder and read it back, so the whole table goes through the writer and the
reader.  Model hooks run deterministic offline stand-ins for the external
models (the engine never ships a model).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from divspark.functions import prompts as P
from divspark.operators import generate as G
from divspark.operators.outliers import centroid_distance
from divspark.operators.parse import parse_responses
from divspark.plans.parse_queries import _parse_sql, exchanges
from divspark.plans.registry import register
from divspark.plans.standins import SEEDED_SQL
from divspark.session import materialize
from divspark.sources import csv_io as IO
from divspark.sources.tables import read_table


@register("csv_roundtrip", "SELECT lang, source, doc_id, text FROM documents")
def csv_roundtrip(spark, sf):
    """S-4 then S-1: documents written as CSV partitioned by (lang, source),
    read back with the labelled-CSV reader (quotes doubled, multi-line fields)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    path = IO.scratch_path(spark, "csv")
    IO.write_runs(d, path, ["lang", "source"], fmt="csv")
    schema = "doc_id long, text string"
    return IO.read_written(spark, path, schema, fmt="csv").select("lang", "source", "doc_id", "text")


@register("layout_read", """
SELECT lang AS dataset, source AS model, CASE WHEN ord(right(source, 1)) % 2 = 0 THEN doc_id ELSE -1 - doc_id END AS doc_id, text
FROM documents""")
def layout_read(spark, sf):
    """S-2 / S-3: the run key taken from the directory layout of every file in one
    read, and per run the first file name that it has: every run has the second one
    (ids negated), those of an even source number the first one too."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    path = IO.scratch_path(spark, "layout")
    even = F.ascii(F.right("source", F.lit(1))) % 2 == 0
    IO.write_runs(d.where(even), path, ["lang", "source"], fmt="csv")
    IO.write_runs(d.withColumn("doc_id", -1 - F.col("doc_id")), path, ["lang", "source"], fmt="csv", mode="append",
                  options={"compression": "gzip"})
    df = IO.read_with_fallback(spark, path, ["part-*.csv", "part-*.csv.gz"], "doc_id long, text string",
                               keys=("dataset", "model"))
    return df.select("dataset", "model", "doc_id", "text")


@register("layout_pruned", """
SELECT lang AS dataset, source AS model, doc_id, text FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src4')""")
def layout_pruned(spark, sf):
    """S-2: four (dataset, model) runs chosen before the read; no other run's file is opened."""
    path = IO.scratch_path(spark, "layout")
    IO.write_runs(read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path, ["lang", "source"], fmt="csv")
    df = IO.read_runs(spark, path, "part-*.csv", "doc_id long, text string", keys=("lang", "source"),
                      only={"lang": ["fr", "de"], "source": ["src1", "src4"]})
    return df.select(F.col("lang").alias("dataset"), F.col("source").alias("model"), "doc_id", "text")


@register("stored_responses_parse", _parse_sql("llama"))
def stored_responses_parse(spark, sf):
    """S-5: raw responses (``array<string>``) stored as Parquet by run, read back
    and parsed again (P-2), so parsing never re-runs generation."""
    ex = exchanges(spark, sf).withColumn(
        "response", F.array(P.fill("[INST] {} [/INST] {}", "seed", "answer")))
    path = IO.scratch_path(spark, "responses")
    IO.write_runs(ex.select("label", "seed", "response"), path, ["label"])
    stored = IO.read_written(spark, path)
    return parse_responses(stored, "llama").select("label", "seed", "text")


def echo_paraphraser(prompts: list[str]) -> list[list[str]]:
    """Offline stand-in model: the phrase of each prompt, its sentences
    numbered 1-3 in turn, as one returned sequence."""
    out = []
    for p in prompts:
        if p is None:
            out.append([""])
            continue
        start = p.find('Original phrase: "')
        body = p[start + 18:] if start >= 0 else p
        end = body.rfind('".')
        body = body[:end] if end >= 0 else body
        sents = [s.strip() for s in body.replace("\n", " ").split(". ") if s.strip()]
        out.append(["\n".join(f"{i % 3 + 1}. {s}" for i, s in enumerate(sents))])
    return out


def _generated_sql():
    from divspark.plans import sqlbits as Q
    strip = Q.strip("x")
    return f"""
WITH u AS (SELECT CAST(conv_id % 8 AS INTEGER) AS label, text AS seed FROM conversations
           WHERE role = 'user' AND text IS NOT NULL),
s AS (SELECT label, seed, unnest(list_filter(list_transform(string_split(replace(seed, chr(10), ' '), '. '),
                                                          lambda x: {strip}), lambda x: x <> '')) AS sent FROM u)
SELECT DISTINCT label, seed, text FROM (SELECT label, seed, {Q.clean('sent', do_strip=False)} AS text FROM s)
WHERE text IS NOT NULL"""


@register("generated_responses", _generated_sql())
def generated_responses(spark, sf):
    """R-1 .. R-3: plain prompts of every user turn sent through a (stand-in)
    model in Arrow batches with retry and pacing, then parsed (P-1)."""
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    prompts = c.select("conv_id", "turn", (F.col("conv_id") % 8).cast("int").alias("label"),
                       F.col("text").alias("seed"), P.plain_prompt("text").alias("prompt"))
    gen = G.generate_responses(prompts, echo_paraphraser, max_calls_per_second=None)
    return parse_responses(gen.where(F.col("error").isNull()), "gpt").select("label", "seed", "text")


class RateLimitError(Exception):
    """What a hosted model raises when it is asked too often."""


_tries: dict[str, int] = {}


def failing_model(prompts: list[str]) -> list[list[str]]:
    """Stand-in model that fails in known ways, by the first hex digit of the
    prompt's md5: 0 always too busy, 1 refuses, 2 busy twice and then answers."""
    out = []
    for p in prompts:
        digit = hashlib.md5(p.encode("utf-8")).hexdigest()[0]
        if digit == "1":
            raise ValueError("refused")
        if digit == "0" or digit == "2" and _tries.setdefault(p, 0) < 2:
            _tries[p] = _tries.get(p, 0) + 1
            raise RateLimitError("busy")
        _tries.pop(p, None)
        out.append([p.upper()])
    return out


@register("generation_failures", """
SELECT conv_id, turn, substr(md5(text), 1, 1) NOT IN ('0', '1') AS answered,
       CASE substr(md5(text), 1, 1) WHEN '0' THEN 'TooManyAttempts' WHEN '1' THEN 'ValueError' END AS error_type
FROM conversations WHERE text IS NOT NULL""")
def generation_failures(spark, sf):
    """R-1 .. R-3 with a model that fails: transient errors retried, ten tries, other
    errors kept as text; every prompt has a row, and a failure costs no other prompt."""
    c = read_table(spark, sf, "conversations").where(F.col("text").isNotNull())
    gen = G.generate_responses(c.select("conv_id", "turn", F.col("text").alias("prompt")), failing_model,
                               waits={"RateLimitError": 0.0}, max_calls_per_second=None)
    kind = F.regexp_extract("error", "^([A-Za-z]+)", 1)
    return gen.select("conv_id", "turn", F.col("response").isNotNull().alias("answered"),
                      F.when(F.col("error").isNotNull(), kind).alias("error_type"))


@register("paced_generation", """
SELECT conv_id, turn, md5(text) AS answer FROM conversations WHERE text IS NOT NULL AND role = 'user'""")
def paced_generation(spark, sf):
    """R-3: every user turn sent one by one at a bounded rate of the whole job (2,000 calls a
    second over four tasks), answered by a stand-in model (the prompt's md5)."""
    c = read_table(spark, sf, "conversations").where("role = 'user' AND text IS NOT NULL")
    gen = G.generate_responses(c.select("conv_id", "turn", F.col("text").alias("prompt")), digest_model, per_prompt=True,
                               max_calls_per_second=2000, partitions=4)
    return gen.select("conv_id", "turn", F.col("response")[0].alias("answer"))


def digest_model(prompts: list[str]) -> list[str]:
    return [hashlib.md5(p.encode("utf-8")).hexdigest() for p in prompts]


def half_dead_model(prompts: list[str]) -> list[str]:
    """Answers prompts whose md5 ends in 0-7, refuses the others."""
    if any(d[-1] not in "01234567" for d in digest_model(prompts)):
        raise ValueError("refused")
    return digest_model(prompts)


@register("resumed_generation", """
WITH c AS (SELECT conv_id, turn, text, md5(text) AS answer FROM conversations WHERE text IS NOT NULL),
half AS (SELECT DISTINCT text, substr(answer, 32, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS early FROM c),
n AS (SELECT count(*) AS prompts, sum(CASE WHEN early THEN 0 ELSE 1 END) AS refused FROM half)
SELECT conv_id, turn, answer, CAST(n.prompts + n.refused AS BIGINT) AS calls FROM c, n""")
def resumed_generation(spark, sf):
    """S-5 / R-2: a first run whose model refuses half of the prompts, a second one that
    answers the rest, a third one with nothing left to ask.  ``calls`` is how many prompts all
    runs sent: every distinct prompt once, the refused ones once more."""
    c = read_table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("prompt"))
    path = IO.scratch_path(spark, "response-log")
    for model in (half_dead_model, digest_model):
        G.generate_missing(c, model, path, per_prompt=True)
    done = G.generate_missing(c, half_dead_model, path, per_prompt=True)
    calls = spark.read.parquet(path).count()
    return done.select("conv_id", "turn", F.col("response")[0].alias("answer")).withColumn("calls", F.lit(calls))


def hashing_encoder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Offline stand-in encoder: L2-normalised hashed bag of words."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[:4], "little")
            v[h % dim] += 1.0 if (h >> 31) & 1 == 0 else -1.0
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def _encoded_sql():
    from divspark.plans import sqlbits as Q
    le = "('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, lang AS run, source AS label, text FROM documents),
w AS (SELECT doc_id, md5(tok) AS h FROM (SELECT doc_id, unnest({Q.ws_tokens('lower(text)')}) AS tok FROM d)),
v AS (SELECT doc_id, {le} AS x FROM w),
c AS (SELECT doc_id, x % 64 AS dim, sum(CASE WHEN (x >> 31) & 1 = 0 THEN 1.0 ELSE -1.0 END) AS cnt
      FROM v GROUP BY doc_id, x % 64),
nr AS (SELECT doc_id, sqrt(sum(cnt * cnt)) AS n FROM c GROUP BY doc_id),
full_v AS (SELECT d.doc_id, d.run, d.label, r.dim,
                  CASE WHEN nr.n > 0 THEN coalesce(c.cnt, 0.0) / nr.n ELSE coalesce(c.cnt, 0.0) END AS val
           FROM d CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) r
           LEFT JOIN c ON c.doc_id = d.doc_id AND c.dim = r.dim
           LEFT JOIN nr ON nr.doc_id = d.doc_id),
cent AS (SELECT run, label, dim, avg(val) AS m FROM full_v GROUP BY run, label, dim)
SELECT f.run, f.label, f.doc_id, round(sqrt(sum((f.val - cent.m) * (f.val - cent.m))), 9) AS distance
FROM full_v f JOIN cent ON f.run = cent.run AND f.label = cent.label AND f.dim = cent.dim
GROUP BY f.run, f.label, f.doc_id"""


@register("encoded_outliers", _encoded_sql())
def encoded_outliers(spark, sf):
    """K-1 then K-2: documents encoded by a (stand-in) sentence encoder in Arrow
    batches, distance to the (lang, source) centroid."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("run"),
                                                  F.col("source").alias("label"), "text")
    e = materialize(G.embed_texts(d, hashing_encoder, double=True))  # the encoder runs once
    out = centroid_distance(e, ["run"])
    return out.select("run", "label", "doc_id", F.round("distance", 9).alias("distance"))


@register("augment_flow")
def augment_flow(spark, sf):
    """The whole collection loop and assembly over every run (run = source,
    label = lang) with stand-in models; the final training sets."""
    from divspark.plans.flow import augment_runs

    train = read_table(spark, sf, "documents").select(F.col("source").alias("dataset"), "text",
                                                      F.col("lang").alias("label"))
    out = augment_runs(train, echo_paraphraser, hashing_encoder, IO.scratch_path(spark, "flow"),
                       keys=("dataset",), ablations=True)
    return out["training_sets"]


@register("streamed_parse", _parse_sql("llama"))
def streamed_parse(spark, sf):
    """P-2 on a stream: responses land as Parquet files, a Structured Streaming
    query parses them (watermarked dedup, checkpoint beside the sink) into
    a Parquet sink, which is read back.  Dedup in the stream holds within the
    watermark delay; the read-back ``distinct`` makes the table exact when a
    duplicate arrives later than that."""
    from divspark.streaming import parse_response_stream, write_parsed_stream

    ex = exchanges(spark, sf).select("label", "seed", P.fill("[INST] {} [/INST] {}", "seed", "answer").alias("response"))
    src, sink = IO.scratch_path(spark, "stream-src"), IO.scratch_path(spark, "stream-sink")
    ex.write.parquet(src)
    stream = parse_response_stream(spark, src, ex.schema, "llama")
    q = write_parsed_stream(stream, sink)
    q.awaitTermination()
    return spark.read.parquet(sink).select("label", "seed", "text").distinct()


def long_word_entities(texts: list[str]) -> list[list[str]]:
    """Offline stand-in NER: every run of nine or more word characters is a span."""
    import re

    pat = re.compile(r"\w{9,}")
    return [pat.findall(t or "") for t in texts]


@register("entity_words_hook", f"""
WITH r0 AS ({SEEDED_SQL}),
d AS (SELECT DISTINCT run, label, text AS seed FROM r0 WHERE text IS NOT NULL)
SELECT DISTINCT run, label, unnest(regexp_extract_all(lower(seed), '[\\p{{L}}\\p{{N}}_]{{9,}}')) AS word FROM d""")
def entity_words_hook(spark, sf):
    """T-6: an entity function applied in Arrow batches to the lower-cased seeds
    of each (run, label) (here the round-0 texts), spans split into words."""
    from divspark.operators.words import entity_words
    from divspark.plans.standins import seeded

    seeds = seeded(spark, sf).select("run", "label", F.col("text").alias("seed")).where(F.col("seed").isNotNull()).distinct()
    spans = G.entity_spans(seeds, long_word_entities, ["run"])
    return entity_words(spans, ["run", "label"]).select("run", "label", "word")
