"""Top-k per group without pulling a group into one task.

* Literal ``k`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``: a
  ``row_number`` window with an ``rn <= k`` filter.  Catalyst plans a partial
  ``WindowGroupLimit`` *before* the shuffle, so every map task keeps at most
  ``k`` rows per group and a hot group ships only ``k x tasks`` rows.
* Data-dependent ``k`` (a column): the largest ``k`` is read as one scalar and
  used as the literal bound of the same plan, then each group is cut to its own
  ``k``.
* ``k`` above the threshold: :func:`rank_within` gives an exact row number
  through a range-partitioned sort, so a hot group is spread over many tasks.
* Only the set of the first ``k`` is asked for, not their ranks, and the order
  begins with a hash: :func:`cut_hash` finds the hash of the k-th row by counting,
  so that no row is sorted or moved, however large ``k`` is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from divspark.operators.joins import join_small
from divspark.session import materialize

WINDOW_LIMIT_DEFAULT = 1000


def threshold(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    except Exception:  # pragma: no cover - conf missing on old versions
        return WINDOW_LIMIT_DEFAULT


def _window_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank_col: str) -> DataFrame:
    w = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= F.lit(k))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k, *,
          rank_col: str = "rank", k_max: int | None = None) -> DataFrame:
    """Keep the first ``k`` rows of each ``keys`` group under ``order``.

    ``order`` must be total (end it with a unique tie-breaker) for a repeatable
    result.  ``k`` is an int or the name of a column holding each group's k;
    ``k_max`` (the largest k, when the caller has it from a small table) saves
    a pass over ``df``.  Adds ``rank_col`` (1-based).
    """
    limit = threshold(df)
    if isinstance(k, int):
        if k <= limit:
            return _window_top(df, keys, order, k, rank_col)
        return rank_within(df, keys, order, rank_col=rank_col).filter(F.col(rank_col) <= k)
    kcol = F.col(k) if isinstance(k, str) else k
    kmax = k_max if k_max is not None else df.agg(F.max(kcol).alias("m")).first()["m"]
    if kmax is None:
        return _window_top(df, keys, order, 0, rank_col)
    if kmax <= limit:
        return _window_top(df, keys, order, int(kmax), rank_col).filter(F.col(rank_col) <= kcol)
    return rank_within(df, keys, order, rank_col=rank_col).filter(F.col(rank_col) <= kcol)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *,
                rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact ``row_number()`` over ``(keys, order)`` with no group in one task.

    Rows are range-partitioned on ``keys + order`` (a hot group spans several
    partitions) and sorted inside each partition; the position inside a
    partition comes from ``monotonically_increasing_id`` (no extra shuffle).
    Per (partition, group) counts form a small table whose running sums give
    each slice's offset.  ``order`` must be total.

    The partitioned, sorted rows are checkpointed once: range bounds come from
    a sample, so a second computation could split the rows differently from
    the one the offsets were counted on.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_exprs = [F.col(c).asc_nulls_first() for c in keys] + list(order)
    part = materialize(df.repartitionByRange(n, *sort_exprs).sortWithinPartitions(*sort_exprs)
                       .withColumn("_pid", F.spark_partition_id())
                       .withColumn("_pos", F.monotonically_increasing_id()))
    slices = part.groupBy("_pid", *keys).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = join_small(part, slices, ["_pid", *keys], null_safe=True)
    return (out.withColumn(rank_col, (F.col("_pos") - F.col("_first") + F.col("_offset") + 1))
            .drop("_pid", "_pos", "_first", "_offset"))


def cut_hash(df: DataFrame, keys: Sequence[str], hash_col: str, sizes: DataFrame, *, prefix: int = 4) -> DataFrame:
    """``(keys, _cut, _need)``: the hash of the k-th smallest row of every group and how
    many rows with that very hash are among the first k.

    ``hash_col`` holds hexadecimal hashes (not null); ``sizes`` has ``keys`` and ``_k``
    (a group whose ``_k`` is 0 or missing is not in the result; ``_k`` may not be above the
    group's size).  Rows are counted by the first ``prefix`` digits, which names the
    bucket of the k-th row; the hashes of that bucket are counted in a second pass.  Both
    are aggregates with map-side counts, so equal rows cost nothing, and what a group
    brings to one task is the ``16 ** prefix`` counts, then its n / 16 ** prefix distinct hashes.
    """
    def place(counts: DataFrame, value: str, wanted: DataFrame, k: str, out: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(value)
        upto = counts.withColumn("_upto", F.sum("_c").over(w))
        at = join_small(upto, wanted, keys, null_safe=True)
        return (at.where((F.col("_upto") >= F.col(k)) & (F.col("_upto") - F.col("_c") < F.col(k)))
                .select(*keys, F.col(value).alias(out), (F.col(k) - F.col("_upto") + F.col("_c")).alias("_need")))

    head = F.substring(F.col(hash_col), 1, prefix)
    counts = df.groupBy(*keys, head.alias("_head")).agg(F.count(F.lit(1)).alias("_c"))
    bucket = place(counts, "_head", sizes.select(*keys, "_k").where("_k > 0"), "_k", "_bucket")
    inside = join_small(df.select(*keys, F.col(hash_col).alias("_hash")), bucket, keys, null_safe=True)
    counts = (inside.where(F.substring("_hash", 1, prefix) == F.col("_bucket")).groupBy(*keys, "_hash")
              .agg(F.count(F.lit(1)).alias("_c")))
    return place(counts, "_hash", bucket.drop("_bucket").withColumnRenamed("_need", "_k"), "_k", "_cut")
