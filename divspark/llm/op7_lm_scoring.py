"""Language-model scoring of whole texts.

1. *Counts.*  Words of all training texts are counted (partial counts in the
   tasks, one shuffle) and stored.
2. *Classes.*  The ``classes - 2`` most frequent words, the text's end, and one
   class for all other words form the vocabulary of a log-bilinear model with
   two words of context.  A word of the last class has, within it, its share of
   the add-one unigram counts, so the whole model is normalised over all words
   and one unknown word.
3. *Training.*  Every training token is seen once.  In each round the partitions
   train on their own texts by noise-contrastive estimation from the same start,
   and the parameters are averaged, weighted by tokens.
4. *Scoring.*  Counts of the ``head`` most frequent words are broadcast (a
   bounded table); the other words of a text meet their counts in a join and
   come back as one sum per text, so no vocabulary size breaks a worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, crc32_of, pick, read, utf8, weighted_means
from divspark.llm.noise_contrastive import LogBilinear

HEAD = 1 << 17  # words whose counts are broadcast
CLASSES = 1024
DIM = 16
RATE = 0.2
FIRST_ROUND = 8  # one of so many training texts is in the first round
PARTIAL = 300_000  # distinct words a task counts before it hands them on
SLICE = 1 << 20
END, RARE = 0, 1  # classes
BLOCKS = 32  # pieces the parameters travel in


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return text.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over all texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()),
                                              "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out
        for b in batches:
            for text in utf8(b.column("text")):
                counts.update(words_of(text))
                if len(counts) > PARTIAL:
                    yield flush()
        if counts:
            yield flush()
    return (texts.select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("c")))


class Head:
    """The most frequent words with counts and classes, as a worker needs them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, classes: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.place = {words[i]: k for k, i in enumerate(order)}
        self.counts = counts[order].astype(np.int64)
        self.neural = min(classes - 2, len(order))  # words with a class of their own

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """(place of every token, -1 end and -2 not in the head; first token of each
        text; the words of each text that are not in the head)."""
        get, ids, rest, starts, at = self.place.get, [], [], [], 0
        for text in texts:
            words = words_of(text)
            starts.append(at)
            found = [get(w, -2) for w in words]
            rest.append([w for w, i in zip(words, found, strict=True) if i == -2])
            found.append(-1)
            ids.append(np.array(found, dtype=np.int32))
            at += len(found)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.array(starts, dtype=np.int64), rest

    def classes(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(previous class, the one before it, class) of every token."""
        t = np.where(ids == -1, END, np.where((ids >= 0) & (ids < self.neural), ids + 2, RARE)).astype(np.int32)
        c1 = np.concatenate([[END], t[:-1]]).astype(np.int32)
        c2 = np.concatenate([[END], c1[:-1]]).astype(np.int32)
        c1[starts], c2[starts] = END, END
        return c1, c2, t


def pick_head(counts: DataFrame, limit: int, classes: int) -> Head:
    """Words above a count threshold that at most ``limit`` words reach; the
    threshold comes from a histogram of counts on a fixed logarithmic scale."""
    level = F.floor(F.log2("c") * 16)
    left, least = limit, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return Head([], np.zeros(0, np.int64), classes)
    got = counts.where(level >= least).toArrow()
    return Head(got["word"].to_pylist(), got["c"].to_numpy(), classes)


def train(texts: DataFrame, head: Head, unigram: np.ndarray, seed: int) -> LogBilinear:
    """``texts``: text, first (in the first round or not)."""
    sc = texts.sparkSession.sparkContext
    model = LogBilinear(unigram, DIM, seed)
    shared = sc.broadcast(head)
    shapes = [(k, v.shape) for k, v in model.params.items()]
    for step in (True, False):
        start = sc.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = LogBilinear.__new__(LogBilinear), 0
            own.unigram = start.value.unigram
            own.params = {k: v.copy() for k, v in start.value.params.items()}
            for b in batches:
                ids, starts, _ = shared.value.encode(utf8(b.column("text")))
                if len(ids):
                    own.train(*shared.value.classes(ids, starts), RATE, seed + seen)
                    seen += len(ids)
            if seen:
                flat = np.concatenate([own.params[k].ravel() for k, _ in shapes])
                parts = np.array_split(flat, BLOCKS)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(range(BLOCKS), pa.int32()), "weight": pa.array([float(seen)] * BLOCKS),
                    "vector": pa.array([p.tobytes() for p in parts], pa.binary())})
        means = weighted_means(texts.where(F.col("first") == step).select("text")
                               .mapInArrow(run, "block int, weight double, vector binary"))
        if means:
            flat, at = np.concatenate([means[k] for k in range(BLOCKS)]), 0
            for k, shape in shapes:
                size = int(np.prod(shape))
                model.params[k] = flat[at:at + size].reshape(shape).copy()
                at += size
    return model


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held: int = 2,
          head_words: int = HEAD, classes: int = CLASSES, seed: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``; learned from the rows whose crc32 of the id as text is
    not ``held`` modulo ``folds``.

    A null or empty text is its end token alone.  A null id is a training row.
    With no training rows every count is 0, and both scores follow from that.  An
    empty table gives an empty result; repeated ids keep one result per row; extra
    columns are ignored.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "lm-scoring")
    docs = pick(df, doc_id=id_col, text=text_col)
    crc = crc32_of(F.col("doc_id"))
    docs = docs.withColumn("held_out", F.pmod(crc, F.lit(folds)) == held)
    training = docs.where("NOT held_out")
    counts = ws.store(count_words(training), "counts")
    sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = training.count()
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    head = pick_head(counts, head_words, classes)
    own = head.counts[:head.neural]
    rare_tokens = tokens - ends - int(own.sum())
    rare_slots = rare_tokens + (distinct - (ends > 0) - head.neural) + 1  # add-one over rare words and one unknown
    unigram = np.concatenate([[ends], [rare_tokens], own]).astype(float) + 1
    first = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(FIRST_ROUND)) == 0
    model = train(training.select("text", F.coalesce(first, F.lit(True)).alias("first")), head, unigram, seed)

    shared = spark.sparkContext.broadcast((head, model))
    log_total, log_rare = np.log10(tokens + distinct + 1), np.log10(rare_slots)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        head, model = shared.value
        ids, starts, rest = head.encode(utf8(b.column("text")))
        c1, c2, t = head.classes(ids, starts)
        logs = np.log10(np.concatenate([head.counts, [0, ends]]) + 1.0)  # the last two: not in the head, end
        part = logs[ids]
        neural = np.concatenate([model.log_probabilities(c1[at:at + SLICE], c2[at:at + SLICE], t[at:at + SLICE])
                                 for at in range(0, len(t), SLICE)])
        rare = t == RARE
        total = np.add.reduceat(neural + np.where(rare, part - log_rare, 0), starts)
        base = np.add.reduceat(part - log_total, starts)
        n = np.diff(np.append(starts, len(ids)))
        known = n - np.array([len(x) for x in rest]) - (0 if ends else 1)
        tails = [Counter(x) for x in rest]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in tails])]).astype(np.int32))
        tail = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            [pa.array([w for x in tails for w in x], pa.binary()),
             pa.array([c for x in tails for c in x.values()], pa.int64())], ["word", "k"]))
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), b.column("row"), pa.array(n, pa.int64()),
             pa.array(known, pa.int64()), pa.array(base), pa.array(total), tail],
            ["doc_id", "held_out", "row", "n_tokens", "known", "base", "total", "tail"])
    scored = ws.store(arrow_map(
        docs.withColumn("row", F.monotonically_increasing_id()), run,
        f"doc_id {id_type}, held_out boolean, row long, n_tokens long, known long, base double, total double, "
        "tail array<struct<word: binary, k: bigint>>"), "scored")
    tails = (scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k")
             .join(counts, "word").groupBy("row")
             .agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log")))
    return (scored.drop("tail").join(tails, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
                    F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("log", F.lit(0.0))).alias("base_score"),
                    (F.col("total") + F.coalesce("log", F.lit(0.0))).alias("score")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
