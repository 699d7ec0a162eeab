"""Toxic passages as maximum-scoring segments of a text's tokens.

Tokens are words.  A word belongs to the classes of its whole form and of its first 4,
5 and 6 code points, so an inflected form that was never seen has the score of its stem.
Classes are hashed into a table of fixed size (``2 ** BITS``), the same at every size of
the input.

1. *Sample.*  Labelled rows outside the held-out fold, at most about ``fit_rows`` of them
   (a documented bound: a hash threshold on the id).  One row in ``1 / CALIBRATION`` is
   set aside for the calibration, the others give the counts.
2. *Copies.*  Four min-hashes of each sampled text tell how many sampled texts share one;
   a text weighs the reciprocal, so a group of near copies counts about once.
3. *Log-odds* of every class between toxic and clean documents, with a Dirichlet prior in
   proportion to the class's share of all documents; classes whose likelihood ratio is
   within the noise of so many classes score nothing.
4. *Segments.*  A word scores the log-odds of its most specific scored class, every other
   word a small negative drift.  One linear scan finds all maximal scoring segments (the
   passages that cannot be extended or split to score more).
5. *Calibration.*  Chance segments of clean text fall off exponentially with their score:
   ``E(s) = K * n * exp(-lambda * s)`` for a text of ``n`` words, ``lambda`` from the
   scores of clean words, ``K`` from the segments of clean texts.  The significant
   segments of a document are joined by the sum statistic of that extreme-value law, and
   its negative logarithm is mapped to a probability by a logistic fit.

Only sums leave the tasks: class counts, score histograms, evidence histograms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, crc32_of, pick, read
from divspark.operators.joins import join_small

BITS = 22
STEMS = (6, 5, 4)  # code points, the longest first
FIT_ROWS = 200_000
CALIBRATION = 0.25
PRIOR = 500.0  # pseudo documents spread over the classes by their share, and one for each class
Z = 5.5  # standard deviations from which log-odds count: one chance class in 2 ** BITS, about
DRIFT = 0.2
SIGNIFICANT = 0.05  # chance segments in a document as long, at most
HASHES = 4
SHINGLE = 5
EVIDENCE_STEP = 0.05
EVIDENCE_MOST = 200.0
KNOWN = 300_000  # remembered words of a worker

WORD = re.compile(r"\w+")
MASK = (1 << BITS) - 1


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_classes(word: str) -> tuple[int, ...]:
    """Class numbers from the most to the least specific: the word, then its stems."""
    forms = [f"={word}", *[word[:k] for k in STEMS if len(word) > k]]
    return tuple(xxhash.xxh64_intdigest(f) & MASK for f in forms)


def segments(scores: Iterable[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, last)`` of a sequence in which the
    listed places have a score and every other place ``-drift``.

    One pass: a new positive piece is joined with the nearest earlier segment that starts
    from a smaller running total, as long as it ends higher than that one did.  Every
    segment remembers that neighbour, so no segment is looked at twice for nothing.
    """
    # an entry: total before it, total at its end, first place, last place, neighbour
    found: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for place, score in scores:
        total -= drift * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        left, right, first = total, total + score, place
        total = right
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= left:
                k = found[k][4]
            if k < 0 or found[k][1] >= right:
                break
            left, _, first, _, link = found[k]
            del found[k:]
            k = link
        found.append((left, right, first, place, k))
    return [(right - left, first, last) for left, right, first, last, _ in found]


class Weights(dict):
    """Log-odds of a word, learned words remembered: the most specific class with a score."""

    def __init__(self, classes: dict[int, float]):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN:
            self.clear()
        got = next((self.classes[c] for c in word_classes(word) if c in self.classes), 0.0)
        self[word] = got
        return got


@dataclass
class Model:
    """What scoring needs; ``classes`` has at most ``2 ** BITS`` entries."""
    classes: dict[int, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    chance: float = 1e-6  # K
    slope: float = 1.0
    offset: float = -3.0

    def weights(self) -> Weights:
        if not hasattr(self, "_weights"):
            self._weights = Weights(self.classes)
        return self._weights

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_weights"}

    def scored(self, words: list[str]) -> list[tuple[int, float]]:
        """(place, log-odds) of the words that have one."""
        score = list(map(self.weights().__getitem__, words))
        return [(k, score[k]) for k in np.flatnonzero(np.array(score)).tolist()] if score else []

    def passages(self, words: list[str]) -> list[tuple[float, int, int]]:
        """The significant segments of a text: ``(score, first word, last word)``."""
        space = self.chance * max(1, len(words))
        return [s for s in segments(self.scored(words), self.drift)
                if space * math.exp(-min(700.0, self.rate * s[0])) <= SIGNIFICANT]

    def evidence(self, words: list[str]) -> float:
        """Negative logarithm of the chance of segments as good as the document's best
        ``r``, for the ``r`` that makes it largest (halving the odds for every further one)."""
        space = math.log(self.chance * max(1, len(words)))
        best = total = 0.0
        scores = sorted((s[0] for s in self.passages(words)), reverse=True)
        for r, s in enumerate(scores, 1):
            total += self.rate * s - space
            if total <= r - 1:
                break
            # the law's tail: exp(-t) * t^(r-1) / (r! (r-1)!)
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            best = max(best, -log_p - (r - 1) * math.log(2))
        return min(best, EVIDENCE_MOST)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -50, 50)))


def texts_of(batch: pa.RecordBatch, col: str = "text") -> Iterator[str]:
    """One text at a time, null as empty."""
    column = batch.column(col)
    return (column[k].as_py() or "" for k in range(batch.num_rows))


def min_hashes(words: list[str]) -> list[int]:
    """``HASHES`` smallest hashes over the word shingles, each under its own mixing."""
    width = min(SHINGLE, max(1, len(words)))
    grams = {" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))}
    base = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams))
    out = []
    for k in range(HASHES):
        h = (base ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((h ^ (h >> np.uint64(29))).min().astype(np.int64)))
    return out


def labelled_sample(labels: DataFrame, folds: int, fit_rows: int) -> DataFrame:
    """``doc_id, y, part`` of about ``fit_rows`` labelled ids outside the held-out fold; an
    id with several labels has the commoner one (1 in a tie)."""
    rows = (labels.where("doc_id IS NOT NULL AND y IS NOT NULL")
            .where(F.pmod(crc32_of(F.col("doc_id")), F.lit(folds)) != 0)
            .groupBy("doc_id").agg((F.avg(F.col("y").cast("double")) >= 0.5).cast("int").alias("y")))
    n = rows.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 32))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) < int(1000 * CALIBRATION)
    return (rows.where(place < F.lit(min(1 << 32, math.ceil((1 << 32) * fit_rows / max(1, n)))))
            .select("doc_id", "y", part.alias("aside")))


def with_copies(docs: DataFrame, sample: DataFrame, ws: Workspace) -> DataFrame:
    """The sample with ``weight``, the reciprocal of how many sampled texts share a min-hash."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, j, h) for k, t in enumerate(texts_of(batch)) for j, h in enumerate(min_hashes(tokens(t)))]
        at, j, h = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at)), pa.array(j, pa.int32()), pa.array(h, pa.int64())],
            ["doc_id", "j", "h"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashes = ws.store(arrow_map(docs.join(F.broadcast(sample.select("doc_id")), "doc_id").select("doc_id", "text"),
                                run, f"doc_id {id_type}, j int, h long"), "hashes")
    shared = hashes.groupBy("j", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = join_small(hashes, shared, ["j", "h"]).groupBy("doc_id").agg(F.max("c").alias("c"))
    return sample.join(copies, "doc_id", "left").withColumn(
        "weight", F.lit(1.0) / F.coalesce("c", F.lit(1))).drop("c")


def class_weights(rows: DataFrame) -> dict[int, float]:
    """Log-odds of the classes that stand out; ``rows``: text, y, weight."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        total = np.zeros((2, 1 << BITS), dtype=np.float32)
        for b in batches:
            for t, y, w in zip(texts_of(b), b.column("y").to_pylist(), b.column("weight").to_pylist(), strict=True):
                if len(known) > KNOWN:
                    known.clear()
                seen: set[int] = set()
                for word in set(tokens(t)):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = word_classes(word)
                    seen.update(got)
                total[y][np.fromiter(seen, dtype=np.int64, count=len(seen))] += w
        at = np.flatnonzero(total.sum(axis=0))
        step = 1 << 16
        for k in range(0, len(at), step):
            part = at[k:k + step]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(total[y][part].astype(float))
                                                                                for y in (0, 1)]],
                                             ["class", "clean", "toxic"])
    counts = (rows.select("text", "y", "weight").mapInArrow(run, "class int, clean double, toxic double")
              .groupBy("class").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .where("clean + toxic > 1").checkpoint())
    total = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not total["toxic"] or not total["clean"]:
        return {}
    n0, n1 = float(total["clean"]), float(total["toxic"])
    seen = F.col("clean") + F.col("toxic")
    prior = F.lit(1.0) + F.lit(PRIOR) * seen / (n0 + n1)  # pseudo documents, split as the labels are
    odds = (F.log((F.col("toxic") + prior * (n1 / (n0 + n1))) / n1)
            - F.log((F.col("clean") + prior * (n0 / (n0 + n1))) / n0))

    def part(got, share: float):
        return F.when(got > 0, got * F.log(got / (seen * share))).otherwise(0.0)
    # signed root of the likelihood ratio against the same share in both kinds of documents
    ratio = part(F.col("toxic"), n1 / (n0 + n1)) + part(F.col("clean"), n0 / (n0 + n1))
    scored = counts.select("class", odds.alias("odds"), F.sqrt(F.greatest(F.lit(0.0), 2 * ratio)).alias("z"))
    got = scored.where(F.col("z") >= Z).select("class", "odds").toArrow()  # at most 2 ** BITS rows
    return dict(zip(got["class"].to_pylist(), got["odds"].to_pylist(), strict=True))


def decay(scores: dict[float, float]) -> float:
    """Positive root of ``sum p(s) exp(lambda s) = 1``, at most 1: log-odds that hold fall
    off at that rate by themselves."""
    n = sum(scores.values())
    if not n or max(scores) <= 0 or sum(s * c for s, c in scores.items()) >= 0:
        return 1.0

    def excess(rate: float) -> float:
        return sum(c / n * math.exp(min(700.0, rate * s)) for s, c in scores.items()) - 1
    low, high = 0.0, 1.0
    if excess(high) <= 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return max(low, 1e-3)


def extreme_values(model: Model, clean: DataFrame) -> None:
    """``lambda`` and ``K`` of clean texts (columns text, weight), from two passes of sums."""
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def histogram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, Counter()
        for b in batches:
            for t, w in zip(texts_of(b), b.column("weight").to_pylist(), strict=True):
                words = tokens(t)
                scored = m.scored(words)
                total[-m.drift] += w * (len(words) - len(scored))
                for _, s in scored:
                    total[round(s * 8) / 8] += w
        yield pa.RecordBatch.from_pydict({"s": pa.array(list(total), pa.float64()),
                                          "c": pa.array(list(total.values()), pa.float64())})
    rows = clean.select("text", "weight").mapInArrow(histogram, "s double, c double").groupBy("s").agg(F.sum("c").alias("c"))
    scores = {r["s"]: r["c"] for r in rows.collect()}  # a few hundred steps of an eighth
    n = sum(scores.values())
    if not n:
        return
    plain = scores.pop(-model.drift, 0.0)
    scored = sum(s * c for s, c in scores.items())
    if plain and scored >= model.drift * plain:  # the law needs a falling score in clean text
        model.drift = 2 * scored / plain
    scores[-model.drift] = scores.get(-model.drift, 0.0) + plain
    model.rate = decay(scores)
    least = 2 / model.rate
    wide = clean.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = wide.value, 0.0
        for b in batches:
            for t, w in zip(texts_of(b), b.column("weight").to_pylist(), strict=True):
                total += w * sum(s[0] >= least for s in segments(m.scored(tokens(t)), m.drift))
        yield pa.RecordBatch.from_pydict({"c": pa.array([total])})
    found = clean.select("text", "weight").mapInArrow(counted, "c double").agg(F.sum("c")).first()[0] or 0.0
    model.chance = (found + 1) / n * math.exp(model.rate * least)


def logistic(model: Model, rows: DataFrame) -> None:
    """Slope and offset of the probability, fitted to a histogram of evidence by label with
    Newton steps; ``rows``: text, y, weight."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, Counter()
        for b in batches:
            for t, y, w in zip(texts_of(b), b.column("y").to_pylist(), b.column("weight").to_pylist(), strict=True):
                total[round(m.evidence(tokens(t)) / EVIDENCE_STEP), y] += w
        yield pa.RecordBatch.from_pydict({"bin": pa.array([k[0] for k in total], pa.int32()),
                                          "y": pa.array([k[1] for k in total], pa.int32()),
                                          "c": pa.array(list(total.values()), pa.float64())})
    got = (rows.select("text", "y", "weight").mapInArrow(run, "bin int, y int, c double").groupBy("bin", "y")
           .agg(F.sum("c").alias("c")).collect())  # EVIDENCE_MOST / EVIDENCE_STEP bins of two labels
    if not got:
        return
    x = np.log1p(np.array([r["bin"] * EVIDENCE_STEP for r in got]))
    y, c = (np.array([float(r[k]) for r in got]) for k in ("y", "c"))
    # targets held off 0 and 1 and a weak pull on the slope keep a separable fit finite
    pos, neg = (c * y).sum(), (c * (1 - y)).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    pull = np.diag([1e-3, 1e-3])

    def loss(b: np.ndarray) -> float:
        t = design @ b
        return float((c * (np.logaddexp(0, t) - goal * t)).sum() + b @ pull @ b / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        step = np.linalg.solve((design * (c * p * (1 - p))[:, None]).T @ design + pull,
                               design.T @ (c * (goal - p)) - pull @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    model.offset, model.slope = float(beta[0]), max(0.0, float(beta[1]))


def fit(df: DataFrame, labels: DataFrame, ws: Workspace, *, folds: int = 5, fit_rows: int = FIT_ROWS) -> Model:
    """Model from ``df`` (doc_id, text) and ``labels`` (doc_id, y)."""
    sample = ws.store(labelled_sample(labels, folds, fit_rows), "sample")
    weighted = ws.store(with_copies(df, sample, ws), "weighted")
    rows = df.join(F.broadcast(weighted), "doc_id")  # about fit_rows narrow rows at most
    model = Model(class_weights(rows.where("NOT aside")))
    aside = rows.where("aside")
    extreme_values(model, aside.where("y = 0"))
    logistic(model, aside)
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", *, folds: int = 5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, passages`` for every row; ``passages``
    holds ``first`` and ``last`` (word numbers from 0), ``score`` and ``text`` of every
    significant segment, in page order.

    Learns from labelled ids whose crc32 as text is not 0 modulo ``folds``.  A null text is
    empty; empty texts have no evidence and the score that goes with it.  A null id is
    never held out and never labelled; repeated rows keep a result each, several labels of
    an id become the commoner one, a null label none.  With an empty label table, or labels
    of one kind, nothing is scored and every document has the score of no evidence.  An
    empty table gives an empty result.  Texts of any length are read whole.  Extra columns
    are ignored.
    """
    ws = Workspace(df.sparkSession, "toxicity")
    docs = pick(df, doc_id=id_col, text=text_col)
    model = fit(docs, pick(labels, doc_id=id_col, y=label_col), ws, folds=folds, fit_rows=fit_rows)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, evidence, passages = shared.value, [], []
        for text in texts_of(batch):
            words = tokens(text)
            evidence.append(m.evidence(words))
            found = sorted(m.passages(words), key=lambda s: s[1])
            spans = [x.span() for x in WORD.finditer(text.lower())] if found and len(text.lower()) == len(text) else None
            passages.append([{"first": a, "last": b, "score": s,
                              "text": text[spans[a][0]:spans[b][1]] if spans else " ".join(words[a:b + 1])}
                             for s, a, b in found])
        score = m.probability(np.array(evidence))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
             pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, pa.float64()),
             pa.array(passages, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()),
                                                    ("score", pa.float64()), ("text", pa.string())])))],
            ["doc_id", "held_out", "score", "predicted", "evidence", "passages"])
    rows = docs.select("doc_id", (F.pmod(crc32_of(F.col("doc_id")), F.lit(folds)) == 0).alias("held_out"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {id_type}, held_out boolean, score double, predicted int, evidence double, "
                                "passages array<struct<first:int,last:int,score:double,text:string>>")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
