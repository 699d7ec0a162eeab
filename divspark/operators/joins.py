"""Joins against a data-derived small side.

A side derived from the data (centroids, per-label counts, taboo lists) has no
size bound known at plan time, so it is broadcast only after it has been
materialised and measured; past the bound the join is a shuffle join and AQE's
skew-join handling splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divspark.session import materialize

DEFAULT_MAX_BROADCAST = 64 * 1024 * 1024


def _broadcast_limit(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        v = int(str(conf).lower().rstrip("b"))
    except ValueError:
        v = DEFAULT_MAX_BROADCAST
    return v


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a DataFrame, bytes as its JSON text plus a word for every
    field (JSON leaves null fields out)."""
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 16 * len(df.columns)), F.lit(0))
               .alias("b")).first()
    return int(r["n"]), int(r["b"])


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", *,
               null_safe: bool = False, max_bytes: int | None = None,
               checkpoint: bool = True) -> DataFrame:
    """Join ``big`` with a data-derived ``small`` side, broadcasting it only when
    its measured size is under ``max_bytes`` (default: the session's broadcast
    threshold; none when that is off).

    ``small`` is checkpointed first (reliable, into ``spark.checkpoint.dir``) so
    measuring it does not recompute its lineage.  ``null_safe`` matches null keys
    with each other (``<=>``), as pandas ``merge`` does.
    """
    on = list(on)
    if not on:  # no key: a constant one, so the plan stays an equi-join
        out = join_small(big.withColumn("_one", F.lit(0)), small.withColumn("_one", F.lit(0)), ["_one"], how,
                         max_bytes=max_bytes, checkpoint=checkpoint)
        return out.drop("_one")
    if checkpoint:
        small = materialize(small)
    limit = _broadcast_limit(big) if max_bytes is None else max_bytes
    _, nbytes = measured_size(small)
    right = F.broadcast(small) if 0 <= nbytes <= limit and limit >= 0 else small
    if not null_safe:
        return big.join(right, on, how)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        e = big[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = e if cond is None else cond & e
    out = big.join(renamed, cond, how)
    return out.drop(*[f"__r_{c}" for c in on])
