"""User-supplied model functions applied in Arrow batches (R-1 .. R-3, K-1, T-6).

Text generation, sentence encoding and entity tagging stay outside the
engine: each is a plain Python function over a list of strings, called once
per Arrow batch inside ``mapInPandas``.  A model that takes long to load is given as
``LoadedOnce(load)``: each Python worker process loads it once and keeps it for all its tasks.
Generation is not repeatable, so a generated table should be written out
(:func:`divspark.sources.csv_io.write_runs`) before anything reads it twice.
"""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The hosted-model retry policy (seconds to wait per error kind, 10 tries).
DEFAULT_WAITS = {"RateLimitError": 10.0, "APIConnectionError": 5.0, "APIError": 5.0, "JSONDecodeError": 5.0,
                 "Timeout": 5.0, "ServiceUnavailableError": 5.0}
MAX_TRIES = 10
#: Bytes of text whose entity spans are made at a time.
SPAN_CHARS = 1 << 20


class TooManyAttempts(RuntimeError):
    pass


def _loaded() -> dict[str, Callable]:
    """This process's models.  The package travels to the workers by value, so its own
    globals are a task's; a module of the process outlives the task."""
    home = sys.modules.setdefault("_divspark_models", types.ModuleType("_divspark_models"))
    return home.__dict__.setdefault("models", {})


class LoadedOnce:
    """A model function for :func:`generate_responses`, :func:`embed_texts` and
    :func:`entity_spans` that is made by ``load()`` in the worker, never on the driver.

    Spark keeps its Python workers between tasks (``spark.python.worker.reuse``, on by
    default), and so is the model: it is loaded at the first batch of the first task that a worker
    runs.  A worker that starts anew, after a lost executor too, loads it again.  A
    worker keeps the ``keep`` models used last, so a session of many models does not
    hold them all.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence]], keep: int = 1):
        self.load, self.keep, self.key = load, keep, uuid.uuid4().hex

    def __call__(self, texts: list[str]) -> Sequence:
        models = _loaded()
        model = models.pop(self.key, None)
        if model is None:
            while len(models) >= max(1, self.keep):
                del models[next(iter(models))]
            model = self.load()
        models[self.key] = model  # last in the order of use
        return model(texts)


def call_with_retry(fn: Callable, arg, *, waits: Mapping[str, float] = DEFAULT_WAITS, max_tries: int = MAX_TRIES,
                    sleep: Callable[[float], None] = time.sleep):
    """R-2 ``request_with_checks``: retry on the listed error kinds (matched by
    class name along the MRO) after their wait; other errors propagate at once."""
    for attempt in range(max_tries):
        try:
            return fn(arg)
        except Exception as e:  # noqa: BLE001 - matched by name below
            names = [c.__name__ for c in type(e).__mro__]
            wait = next((waits[n] for n in names if n in waits), None)
            if wait is None:
                raise
            if attempt + 1 >= max_tries:
                break
            sleep(wait)
    raise TooManyAttempts(f"too many attempts ({max_tries})")


class _Pacer:
    """R-3: a task's share of the job's ``rate`` calls a second: one call every ``tasks / rate``
    seconds, the first one in the task's own slot, so that calls of all tasks together
    are ``1 / rate`` apart on average and never more than one a task within that time."""

    def __init__(self, rate: float | None, tasks: int = 1, number: int = 0, sleep=time.sleep, clock=time.monotonic):
        self.gap = tasks / rate if rate else 0.0
        self.sleep, self.clock = sleep, clock
        self.last = clock() - self.gap + number / rate if rate else None

    def wait(self):
        if self.gap and self.last is not None:
            delay = self.last + self.gap - self.clock()
            if delay > 0:
                self.sleep(delay)
        self.last = self.clock()


def generate_responses(prompts: DataFrame, generate_fn: Callable[[list[str]], Sequence], *,
                       prompt: str = "prompt", out: str = "response", per_prompt: bool = False,
                       waits: Mapping[str, float] = DEFAULT_WAITS, max_tries: int = MAX_TRIES,
                       max_calls_per_second: float | None = None, fail_fast: bool = False,
                       partitions: int | None = None) -> DataFrame:
    """R-1 ``collect_samples``: every row gets ``out`` (``array<string>``, the
    returned sequences) from ``generate_fn``; all other columns (the seed, the
    run key) are carried through.

    ``generate_fn`` takes a list of prompts and returns, per prompt, a string
    or a list of strings.  ``per_prompt=True`` calls it with one prompt at a
    time (hosted APIs), with retry (R-2) and pacing (R-3) around each call.
    With ``fail_fast=False`` a failed call leaves ``out`` null and the message
    in ``error`` instead of failing the job; when a call of several prompts fails,
    each of them is tried alone, so one bad prompt costs only itself.
    ``partitions`` spreads the prompts evenly over that many tasks (default: the
    session's parallelism; 0 leaves them where they are); that is how many calls
    run at a time.  ``max_calls_per_second`` bounds the calls of the whole job: every
    task has an equal share of it, whatever their number, so it needs ``partitions``
    other than 0.
    """
    n = prompts.sparkSession.sparkContext.defaultParallelism if partitions is None else partitions
    if max_calls_per_second and not n:
        raise ValueError("a rate is shared among a known number of tasks: set partitions")
    if n:
        prompts = prompts.repartition(n)
    schema = T.StructType(prompts.schema.fields + [T.StructField(out, T.ArrayType(T.StringType())),
                                                   T.StructField("error", T.StringType())])

    def norm(r):
        if r is None:
            return None
        return [str(x) for x in r] if isinstance(r, (list, tuple)) else [str(r)]

    def alone(text, pacer):
        pacer.wait()
        try:
            res = list(call_with_retry(generate_fn, [text], waits=waits, max_tries=max_tries))
            return norm(res[0]), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        number = TaskContext.get().partitionId() if TaskContext.get() else 0
        pacer = _Pacer(max_calls_per_second, max(1, n), number)
        for pdf in batches:
            texts = pdf[prompt].astype(object).where(pdf[prompt].notna(), None).tolist()
            results, errors = [], []
            calls = [[t] for t in texts] if per_prompt else [texts]
            for call in calls:
                pacer.wait()
                try:
                    res = call_with_retry(generate_fn, call, waits=waits, max_tries=max_tries)
                    res = list(res)
                    if len(res) != len(call):
                        raise ValueError(f"generate_fn returned {len(res)} results for {len(call)} prompts")
                    results += [norm(r) for r in res]
                    errors += [None] * len(call)
                except Exception as e:  # noqa: BLE001
                    if fail_fast:
                        raise
                    if len(call) > 1:
                        for t in call:
                            one, err = alone(t, pacer)
                            results.append(one)
                            errors.append(err)
                        continue
                    results += [None] * len(call)
                    errors += [f"{type(e).__name__}: {e}"] * len(call)
            yield pdf.assign(**{out: pd.Series(results, index=pdf.index, dtype=object),
                                "error": pd.Series(errors, index=pdf.index, dtype=object)})

    return prompts.mapInPandas(run, schema)


def generate_missing(prompts: DataFrame, generate_fn: Callable[[list[str]], Sequence], log_path: str, *,
                     prompt: str = "prompt", out: str = "response", **options) -> DataFrame:
    """S-5 / R-2 resumable R-1: responses come from the log at ``log_path``, and only prompts
    that it does not answer are sent to the model.

    The log is a Parquet table ``(prompt_key, response, error, attempt)``, keyed by the sha-256
    of the prompt; a run of this function appends one attempt: every *distinct* open
    prompt once.  What an interrupted or failed run has answered is never asked again; a
    failed prompt is, the next time.  Appending the same attempt again is harmless: a
    prompt's answer is the one of its first answering attempt.  Null prompts are not sent
    and have neither response nor error.  Returns ``prompts`` with ``out`` and ``error`` (of the
    last attempt, where there is no answer).
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_key", F.sha2(F.col(prompt).cast("binary"), 256))
    path = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    fields = "prompt_key string, response array<string>, error string, attempt int"

    def log() -> DataFrame:
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(fields).parquet(log_path) if there else spark.createDataFrame([], fields)
    before = log()
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    answered = before.where("response IS NOT NULL").select(F.col("prompt_key").alias("_key")).distinct()
    pending = (keyed.where(F.col(prompt).isNotNull()).select("_key", F.col(prompt).alias("prompt")).distinct()
               .join(answered, "_key", "left_anti"))
    new = generate_responses(pending, generate_fn, prompt="prompt", out="response", **options)
    (new.select(F.col("_key").alias("prompt_key"), "response", "error", F.lit(attempt).alias("attempt"))
     .write.mode("append").parquet(log_path))
    first = F.min_by("response", "attempt")
    known = log()
    answers = (known.where("response IS NOT NULL").groupBy("prompt_key").agg(first.alias(out)).withColumn("error", F.lit(None).cast("string"))
               .unionByName(known.groupBy("prompt_key").agg(F.max_by("error", "attempt").alias("error"), F.max(F.col("response").isNotNull()).alias("_ok"))
                            .where("NOT _ok").select("prompt_key", F.lit(None).cast("array<string>").alias(out), "error")))
    return keyed.join(answers.withColumnRenamed("prompt_key", "_key"), "_key", "left").select(*prompts.columns, out, "error")


def embed_texts(df: DataFrame, encoder: Callable[[list[str]], Sequence[Sequence[float]]], *,
                text: str = "text", out: str = "embedding", double: bool = False) -> DataFrame:
    """K-1 ``get_embs_for_sents``: ``out`` = ``encoder(texts)`` per Arrow batch,
    stored as ``array<float>`` (as sentence encoders return) or, with
    ``double=True``, ``array<double>``."""
    elem = T.DoubleType() if double else T.FloatType()
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(elem))])

    def run(batches):
        for pdf in batches:
            texts = pdf[text].astype(object).where(pdf[text].notna(), "").tolist()
            vecs = [None if v is None else [float(x) for x in v] for v in encoder(texts)]
            yield pdf.assign(**{out: pd.Series(vecs, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)


def entity_spans(df: DataFrame, entity_fn: Callable[[list[str]], Sequence[Sequence[str]]], keys: Sequence[str], *,
                 label: str = "label", text: str = "seed") -> DataFrame:
    """T-6 NER over the seeds: ``(keys, label, span)`` for every entity span
    ``entity_fn`` finds in ``lower(text)``."""
    src = df.select(*keys, label, text)
    schema = T.StructType([*(src.schema[k] for k in keys), src.schema[label], T.StructField("span", T.StringType())])
    lead = [*keys, label]

    def run(batches):
        for whole in batches:
            # the spans of a few texts at a time: a batch's, as objects, are many times its texts
            for b in _of_size(whole, whole.schema.get_field_index(text)):
                texts = [(t or "").lower() for t in b.column(text).to_pylist()]
                found = [[s for s in spans or () if s is not None] for spans in entity_fn(texts)]
                take = pa.array(np.repeat(np.arange(b.num_rows), [len(spans) for spans in found]))
                spans = pa.array([s for spans in found for s in spans], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in lead], spans], [*lead, "span"])

    return src.mapInArrow(run, schema)


def _of_size(batch: pa.RecordBatch, text: int, chars: int = SPAN_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of about ``chars`` bytes of text at most, or of one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > start and held + n > chars:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n + 64
    if batch.num_rows > start:
        yield batch.slice(start)
