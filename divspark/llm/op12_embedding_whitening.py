"""Whitening of embeddings by a polarisation covariance.

Entries become whole numbers ``x = floor(64 * c) + 1000000``.  With ``n`` vectors in
the fit list and per-dimension sums ``S``, the centred value ``y = n * x - S`` is a
whole number too, so the squares

    Q(d) = sum of y_d ^ 2            for every dimension
    Q(d, e) = sum of (y_d + y_e) ^ 2 for every pair of dimensions

are exact sums, and ``(Q(d, e) - Q(d) - Q(e)) / 2`` is the exact cross product: only
variances are aggregated, their differences give every covariance.

1. The fit list (each distinct vector once) is one aggregation with map-side
   combination, stored; ``n`` and ``S`` are sums over it.
2. Every task squares the centred values and pair sums of its rows in whole numbers
   (in limbs where a sum of squares could pass 63 bits); one row per dimension and
   pair leaves a task, added up exactly as decimals.
3. ``D (D + 1) / 2`` numbers (bounded by the dimension, not by the rows) come to the
   driver, which assembles the matrix for ``eigh``.
4. The fit list is read again for the covariance of the whitened vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, pick, read

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LIMB = 15
ROWS = 4096  # rows squared at once
#: Eigenvalues below this share of the largest one are noise of the decomposition.
RANK_SHARE = 1e-12

SUMS = "slot int, total decimal(38,0)"
RESULT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whole(col: str):
    """``x`` of an array of numbers."""
    return F.transform(F.col(col), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))


def usable(col: str):
    """The vector and all its entries are there and finite."""
    bad = F.exists(F.col(col), lambda c: c.isNull() | F.isnan(c.cast("double"))
                   | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(batch.num_rows, dim)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return n * x - sums[None, :]


def square_sums(v: np.ndarray) -> list[int]:
    """Exact sums of squares down the columns of whole numbers."""
    if not v.size:
        return [0] * v.shape[1]
    most = max(1, int(np.abs(v).max()))
    if most * most * len(v) < 1 << 62:
        return (v * v).sum(axis=0).tolist()
    limbs, rest = [], np.abs(v)
    while rest.any():
        limbs.append(rest & ((1 << LIMB) - 1))
        rest = rest >> LIMB
    total = [0] * v.shape[1]
    for i, a in enumerate(limbs):
        for j in range(i + 1):
            part = (a * limbs[j]).sum(axis=0).tolist()
            twice = 1 if i == j else 2
            total = [t + (twice * p << (LIMB * (i + j))) for t, p in zip(total, part, strict=True)]
    return total


def slots(dim: int) -> list[tuple[int, int]]:
    """Slot numbers of the sums: every dimension (``e == d``), then its pairs with later ones."""
    return [(d, e) for d in range(dim) for e in range(d, dim)]


def polarised(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """``Q(d)`` and ``Q(d, e)`` of some rows, in the order of :func:`slots`."""
    y, out = centred(x, n, sums), []
    for d in range(y.shape[1]):
        out += square_sums(y[:, d:d + 1])
        out += square_sums(y[:, d:d + 1] + y[:, d + 1:])
    return out


def task_sums(df: DataFrame, dim: int, fn: Callable[[np.ndarray], list[int]]) -> dict[int, int]:
    """Exact totals by slot of a function of row blocks: one row per slot and task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = fn(matrix(b.slice(at, ROWS), dim))
                total = part if total is None else [s + t for s, t in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                ["slot", "total"])
    sums = df.select("x").mapInArrow(run, SUMS).groupBy("slot").agg(F.sum("total").alias("total"))
    return {r["slot"]: int(r["total"]) for r in sums.collect()}


def covariance(q: dict[int, int], n: int, dim: int) -> np.ndarray:
    """Covariance of ``x`` (divisor ``n``) from the exact sums of squares."""
    at = {p: k for k, p in enumerate(slots(dim))}
    out = np.zeros((dim, dim))
    for (d, e), k in at.items():
        cross = 2 * q[k] if d == e else q[k] - q[at[d, d]] - q[at[e, e]]
        out[d, e] = out[e, d] = cross / (2 * n ** 3)  # whole numbers divided once, correctly rounded
    return out


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), largest first, without the null space."""
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:most]
    order = order[value[order] > max(value.max(initial=0.0), 0.0) * RANK_SHARE]
    return value[order], vector[:, order]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
           most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every
    usable row and component.

    A vector that is null or empty, or holds a null, NaN or infinite entry is dropped;
    so is one whose length is not the table's (the length most usable rows have, the
    smaller of equals).  Repeated rows and null ids keep a result each, while the fit
    list holds a vector once.  Eigenvalues that are zero have no component: a table of
    fewer than two distinct vectors, or an empty one, gives an empty result.  Equal
    eigenvalues leave their eigenvectors free within their plane, as in ``eigh``.
    Extra columns are ignored.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "whitening")
    rows = pick(df, vec_id=id_col, v=vector_col).where(usable("v"))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, {RESULT}"
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["d"]
    rows = rows.where(F.size("v") == dim).select("vec_id", whole("v").alias("x"))
    fit = ws.store(rows.select("x").distinct(), "fit")
    n = fit.count()
    got = task_sums(fit, dim, lambda x: x.sum(axis=0).tolist())
    sums = np.array([got[d] for d in range(dim)], dtype=np.int64)
    cov = covariance(task_sums(fit, dim, lambda x: polarised(x, n, sums)), n, dim)
    value, vector = components(cov, most)
    if not len(value):
        return spark.createDataFrame([], schema)
    explained = value / np.trace(cov)
    project = vector / np.sqrt(value)[None, :]

    def whitened(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums) / n @ project

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((len(value), len(value))), np.zeros(len(value))
        for b in batches:
            w = whitened(matrix(b, dim))
            total += w.T @ w
            mean += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(total.size + mean.size), pa.int32()),
                                          "total": pa.array(np.append(total.ravel(), mean))})
    parts = fit.mapInArrow(moments, "slot int, total double").groupBy("slot").agg(F.sum("total").alias("t")).collect()
    flat = np.array([r["t"] for r in sorted(parts, key=lambda r: r["slot"])]) / n
    k = len(value)
    second, mean = flat[:k * k].reshape(k, k), flat[k * k:]
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, count = matrix(batch, dim), batch.num_rows
        y = centred(x, n, sums)
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), k))),
             pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
             pa.array(np.full(count * k, n, dtype=np.int64)),
             pa.array(np.repeat((y * y).sum(axis=1), k)), pa.array(whitened(x).ravel()),
             pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return arrow_map(rows, run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
