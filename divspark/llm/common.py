"""Shared helpers: stored intermediate tables and Arrow batch handling."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.session import checkpoint_dir

#: Upper bound on the bytes of one Arrow batch handed to a Python worker, so a
#: batch of very long texts stays small (Spark's own bound counts rows only).
BATCH_BYTES = 8 << 20

# batches come and go in the workers: the system allocator gives their memory back
pa.set_memory_pool(pa.system_memory_pool())


class Workspace:
    """Tables an operator writes once and reads again, in the shared folder of
    ``spark.checkpoint.dir``.  A stored table cuts the lineage: a lost executor
    costs a re-read, never a recomputation of what lies above."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/divspark-llm/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def store(self, df: DataFrame, table: str, few: bool = False) -> DataFrame:
        """Write and read again.  ``few``: a small result of a wide shuffle, written as
        an eighth as many files as the shuffle has partitions."""
        path = f"{self.root}/{table}"
        if few:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete stored tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{t}")
            path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Select columns under the operator's own names; a df's other columns,
    whatever they are called, cannot clash with the operator's."""
    return df.select(*[df[f"`{src}`"].alias(dst) for dst, src in cols.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed ``c0, c1, ...``, so that an operator's own
    columns can stand beside them."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), names


def crc32_of(col: Column) -> Column:
    """crc32 of an id as text; -1 for a null id, which belongs to no fold."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(-1))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def utf8(col: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def weighted_means(rows: DataFrame) -> dict[int, "np.ndarray"]:
    """Weighted mean of float32 vectors by block; ``rows``: block int, weight double,
    vector binary.  Each block's rows stream through one task and only their sum is
    held; as many rows as there are blocks come to the driver."""
    import numpy as np

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for block, w, raw in zip(*(b.column(c).to_pylist() for c in ("block", "weight", "vector")), strict=True):
                part = np.frombuffer(raw, dtype=np.float32).astype(np.float64) * w
                if block in total:
                    total[block][0] += w
                    total[block][1] += part
                else:
                    total[block] = [w, part]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(total), pa.int32()),
            "vector": pa.array([(v / w).astype(np.float32).tobytes() for w, v in total.values()], pa.binary())})
    out = rows.repartition("block").mapInArrow(run, "block int, vector binary").collect()
    return {r["block"]: np.frombuffer(bytes(r["vector"]), dtype=np.float32) for r in out}
