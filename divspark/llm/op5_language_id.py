"""Language identification in two levels.

Level 1 picks the language *family* (one-versus-rest linear models), level 2
separates the languages within that family by one-versus-one linear support
vector machines.  All models read the same features: relative frequencies of
hashed byte n-grams (1 to 4) of the lower-cased text with every run of
non-letters as one space, scaled by the training spread.

Fitting uses a bounded, documented sample: about ``per_language`` labelled rows of
each language, those training rows whose hashed id falls below a threshold (and
never more than twice as many in all).  Each sampled
text also gives two short excerpts, so short texts are learned too.  Prediction
reads every whole text, in Arrow batches, as sums over numpy slices of bounded
size; a text of any length costs bounded memory.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import BATCH_BYTES, Workspace, arrow_map, crc32_of, numbered, pick, read

#: Families of language codes.  A code that is not listed is a
#: family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ast", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNDETERMINED = "und"
BITS = 16
GRAMS = (1, 2, 3, 4)
SLICE = 1 << 18
STEEPNESS = 4.0


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes), f"own:{lang}")


def clean(col: pa.Array) -> pa.Array:
    col = pc.utf8_lower(col.cast(pa.large_string()))
    return pc.replace_substring_regex(pc.fill_null(col, ""), r"[^\p{L}]+", " ")


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-grams that start at each position of ``data`` (uint8)."""
    size = len(data) - n + 1
    code = data[:size].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | data[k:k + size]
    code = (code + np.uint32(n)) * np.uint32(2654435761)
    return (code ^ (code >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a cleaned column."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def score_texts(col: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean over its n-grams of the weight rows, and the number of n-grams."""
    data, offsets = text_buffer(col)
    sums = np.zeros((len(col), weights.shape[1]))
    width = max(GRAMS)
    for at in range(0, len(data), SLICE):
        end = min(len(data), at + SLICE)
        part = data[at:min(len(data), end + width - 1)]
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, end, side="left"))
        edges = np.clip(offsets[first:last + 1], at, end) - at
        left = np.repeat(offsets[first + 1:last + 1], np.diff(edges)) - np.arange(at, end)
        total = np.zeros((end - at, weights.shape[1]), dtype=np.float32)
        for n in GRAMS:
            h = buckets(part, n)[:end - at]
            w = weights[h]
            w[left[:len(h)] < n] = 0
            total[:len(h)] += w
        running = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(total, axis=0, dtype=np.float64)])
        sums[first:last] += running[edges[1:]] - running[edges[:-1]]
    size = np.diff(offsets)
    grams = sum(np.maximum(size - n + 1, 0) for n in GRAMS)
    return sums / np.maximum(grams, 1)[:, None], grams


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, relative frequency) of one cleaned text."""
    data = np.frombuffer(text, dtype=np.uint8)
    count = np.zeros(1 << BITS, dtype=np.int32)
    for n in GRAMS:
        if len(data) >= n:
            for at in range(0, len(data), SLICE):
                count += np.bincount(buckets(data[at:at + SLICE + n - 1], n)[:SLICE],
                                     minlength=1 << BITS).astype(np.int32)
    idx = np.flatnonzero(count)
    return idx.astype(np.int32), (count[idx] / max(1, count.sum())).astype(np.float32)


def training_rows(docs: DataFrame) -> DataFrame:
    """Features of the sampled texts and of two excerpts of each."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, idx, val = [], [], []
        texts = clean(batch.column("text")).cast(pa.large_binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            words = text.split()
            for part in (text, b" ".join(words[:6]), b" ".join(words[len(words) // 2:][:12])):
                i, v = features(part)
                if len(i):
                    langs.append(lang), idx.append(i), val.append(v)
        return pa.RecordBatch.from_pydict(
            {"lang": pa.array(langs, pa.string()), "idx": pa.array(idx, pa.list_(pa.int32())),
             "val": pa.array(val, pa.list_(pa.float32()))})
    return arrow_map(docs, run, "lang string, idx array<int>, val array<float>")


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, dim: int,
            cost: float = 10.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by dual coordinate descent; the last weight is the bias."""
    w, bias = np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    upper = np.where(sign > 0, (sign < 0).sum(), (sign > 0).sum()) / len(sign) * 2  # balanced classes
    diag = 0.5 / (cost * np.maximum(upper, 1e-3))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            grad = sign[i] * (float(w[idx] @ v) + bias) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - grad / (norm[i] + diag[i]), 0.0)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[idx] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


class Model:
    """Weights of all linear models side by side: families, then pairs of languages."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = [[x for x in self.langs if family_of(x) == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        dim = 1 << BITS
        mean = np.zeros(dim)
        for _, idx, val in rows:
            mean[idx] += val
        scale = 1 / np.sqrt(mean / max(1, len(rows)) + 1e-5)
        scaled = [(lang, idx, (val * scale[idx]).astype(np.float32)) for lang, idx, val in rows]
        columns, self.bias = [], []

        def fit(chosen: list, sign: list[int]) -> None:
            w, b = fit_svm([(i, v) for _, i, v in chosen], np.array(sign, dtype=float), dim)
            columns.append((w * scale).astype(np.float32))
            self.bias.append(b)
        if len(self.families) > 1:
            for f in self.families:
                fit(scaled, [1 if family_of(x[0]) == f else -1 for x in scaled])
        for a, b in self.pairs:
            chosen = [x for x in scaled if x[0] in (a, b)]
            fit(chosen, [1 if x[0] == a else -1 for x in chosen])
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((dim, 0), dtype=np.float32)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score in 0..1) of each cleaned text; the caller sets texts without letters aside."""
        margin, _ = score_texts(col, self.weights)
        margin = margin + np.array(self.bias)[None, :]
        many = len(self.families) if len(self.families) > 1 else 0
        if many:
            fam = margin[:, :many].argmax(axis=1)
            rival = np.sort(margin[:, :many], axis=1)
            score = 1 / (1 + np.exp(-STEEPNESS / 2 * (rival[:, -1] - rival[:, -2])))
        else:
            fam, score = np.zeros(len(col), dtype=int), np.ones(len(col))
        lang = np.empty(len(col), dtype=object)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(fam == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = 1 / (1 + np.exp(-STEEPNESS * margin[rows, many + k]))
                    votes[:, members.index(a)] += (p > 0.5) + p * 1e-3  # a tie of votes goes to the margins
                    votes[:, members.index(b)] += (p <= 0.5) + (1 - p) * 1e-3
            best = votes.argmax(axis=1)
            lang[rows] = np.array(members, dtype=object)[best]
            if len(members) > 1:
                sure = np.ones(len(rows))
                for k, (a, b) in enumerate(self.pairs):
                    if a in members:
                        p = 1 / (1 + np.exp(-STEEPNESS * margin[rows, many + k]))
                        sure = np.where(best == members.index(a), np.minimum(sure, p), sure)
                        sure = np.where(best == members.index(b), np.minimum(sure, 1 - p), sure)
                score[rows] *= sure
        return lang.tolist(), score


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
        train: Column | None = None, per_language: int = 400) -> Model | None:
    """Model from about ``per_language`` labelled rows a language (None: no labelled row)."""
    rows = pick(df.where(train) if train is not None else df, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    # a row is sampled when its hash falls below the share its language needs
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 32))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items()
                           for x in (lang, min(1 << 32, math.ceil((1 << 32) * per_language / n)))])
    sample = rows.where(place < share[F.col("lang")]).limit(2 * per_language * len(counts))
    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(
            b.column("lang").to_pylist(), *([np.asarray(x.values) for x in b.column(c)] for c in ("idx", "val")),
            strict=True)]
        if rows:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(Model(rows)))], pa.binary())})
    # the sample is bounded: one task fits, the driver gets the weights
    got = (training_rows(sample.select("text", "lang")).repartition(1)
           .mapInArrow(learn, "model binary").collect())
    if not got:
        return None
    model = Model.__new__(Model)
    vars(model).update(pickle.loads(bytes(got[0]["model"])))
    return model


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` before ``text_col`` is dropped, with ``lang_pred`` and ``score``.

    A null text, one without a letter (Unicode category L), or any text when
    nothing could be learned gives ``und`` with score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != text_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, col, model = batch.num_rows, batch.column(text_col), shared.value
        lang, score = [UNDETERMINED] * n, np.zeros(n)
        has = np.asarray(pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False))
        rows = np.flatnonzero(has)
        if model is not None and len(rows):
            size = np.asarray(pc.binary_length(col.take(pa.array(rows)))).cumsum()
            for part in np.split(rows, np.flatnonzero(np.diff(size // (BATCH_BYTES // 4))) + 1):
                found, sure = model.predict(clean(col.take(pa.array(part))))
                score[part] = sure
                for i, x in zip(part.tolist(), found, strict=True):
                    lang[i] = x
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))],
            [*keep, "lang_pred", "score"])
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(df, run, f"{fields}{', ' if keep else ''}lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             folds: int = 5, per_language: int = 400) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from the rows
    whose crc32 of the id as text is not 0 modulo ``folds`` and whose language is known.

    A null id is never held out.  An empty table gives an empty result; ids that
    repeat keep one result per row; extra columns are ignored.
    """
    Workspace(df.sparkSession, "language-id")
    held = F.pmod(crc32_of(F.col(f"`{id_col}`")), F.lit(folds)) == 0
    model = fit(df, id_col, text_col, lang_col, train=~held, per_language=per_language)
    rows = pick(df, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", (F.pmod(crc32_of(F.col("doc_id")), F.lit(folds)) == 0).alias("held_out"), "text")
    return predict(rows, model)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language, with all their columns; ``und`` goes."""
    Workspace(df.sparkSession, "language-id")
    held = F.pmod(crc32_of(F.col(f"`{id_col}`")), F.lit(5)) == 0
    model = fit(df, id_col, text_col, lang_col, train=~held)
    named, own = numbered(df)
    named = named.withColumn("probe", F.col(own[df.columns.index(text_col)]))
    return (predict(named, model, "probe").where(F.col("lang_pred") != UNDETERMINED)
            .select(*own).toDF(*df.columns))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
