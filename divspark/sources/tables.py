"""The driver's parquet tables (``<sf_dir>/<name>.parquet``)."""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The id column of each table, used when a table has to be split.
ID_COLUMNS = {"documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id", "conversations": "conv_id",
              "benchmark": "item_id", "pages": "page_id"}

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

_staged: dict[tuple, str] = {}
_lock = threading.Lock()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def _row_groups(path: str, enough: int) -> int | None:
    """Row groups of a local parquet file or folder (None: not local / unknown)."""
    try:
        import pyarrow.parquet as pq

        files = [path] if os.path.isfile(path) else [
            os.path.join(dp, f) for dp, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
        if not files:
            return None
        if len(files) >= enough:  # every file has a row group: no footer to open
            return len(files)
        return sum(pq.ParquetFile(f).metadata.num_row_groups for f in files)
    except Exception:
        return None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    A row group is the unit of a parquet scan task, so a table stored as fewer
    row groups than the session's parallelism would be read, and everything
    up to the first shuffle computed, by a few tasks.  Such a table is staged
    once per session as a copy split by its id column in the shared scratch
    folder (``spark.checkpoint.dir``), then read from there with the same
    pushdown and pruning.  Inputs already split finely (any real one) are read
    as they are.
    """
    path = table_path(sf_dir, name)
    target = spark.sparkContext.defaultParallelism
    groups = _row_groups(path, target)
    if groups is None or groups >= target:
        return spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, os.path.abspath(path), os.path.getmtime(path), target)
    with _lock:
        staged = _staged.get(key)
        if staged is None:
            from divspark.sources.csv_io import scratch_path

            staged = scratch_path(spark, f"staged-{name}")
            df = spark.read.parquet(path)
            col = ID_COLUMNS.get(name)
            (df.repartition(target, col) if col in df.columns else df.repartition(target)) \
                .write.mode("overwrite").parquet(staged)
            _staged[key] = staged
    return spark.read.parquet(staged)
