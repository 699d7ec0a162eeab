"""Packing of tokenised documents into sequences of a fixed capacity.

1. Every document is encoded once, in Arrow batches; longer ones are cut into
   pieces of the full capacity.  The pieces (no ids, only lengths) are stored.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to one task,
   which solves and rounds the configuration linear program (``config_lp``).
3. The result says, for each length, which ranks of its pieces go to which
   copies of which configuration.  A piece's rank among those of its length is
   a prefix sum over (length, bucket) counts plus its place in the bucket, so no
   task ever holds one length's pieces; the slots (bounded as the histogram is)
   are broadcast and looked up by binary search.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from divspark.llm import config_lp
from divspark.llm.chunk_tokens import encoder
from divspark.llm.common import Workspace, arrow_map, pick, read, utf8

CAPACITY = 4096
END_ID = 1
SLOTS = ("key", "copies", "sequence", "offset")
RANK_BITS = 48  # a slot key is length * 2**RANK_BITS + first rank

PIECES = "doc_id {id}, piece int, start long, length int, ids_crc32 long"


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids) // 4
    return [(k, at, min(capacity, n - at), zlib.crc32(ids[4 * at:4 * min(n, at + capacity)]))
            for k, at in enumerate(range(0, n, capacity))]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(vocabulary).encode(utf8(batch.column("text")))
        rows = [(i, *p) for i, x in enumerate(ids) for p in cut(x + end, capacity)]
        at, piece, start, length, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"])
    return arrow_map(docs, run, PIECES.format(id=id_type))


def slots_of(configs: dict[config_lp.Config, int]) -> tuple[np.ndarray, ...]:
    """Slot table sorted by key: (key, copies per sequence, first sequence, first offset).
    Ranks ``key .. key + copies * sequences - 1`` of a length go to one configuration."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, bins in configs.items():
        offset = 0
        for length, copies in config:
            rows.append(((length << RANK_BITS) + taken[length], copies, sequence, offset))
            taken[length] += copies * bins
            offset += length * copies
        sequence += bins
    return tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) if rows else ()


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None,
         capacity: int = CAPACITY, rounds: int = 60) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text counts as empty: such a document is its end id alone, a piece of
    length 1.  Null and repeated ids keep one set of pieces per row; ties among
    pieces of a length are broken by their place in the stored table.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    import public_tokenizers

    spark = df.sparkSession
    ws = Workspace(spark, "packing")
    docs = pick(df, doc_id=id_col, text=text_col)
    pieces = ws.store(
        pieces_of(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"), capacity)
        .withColumn("row", F.monotonically_increasing_id()), "pieces")

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = ws.store(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = {k: n for b in batches for k, n in zip(b.column("length").to_pylist(), b.column("n").to_pylist(),
                                                      strict=True)}
        if hist:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in slots_of(config_lp.pack(hist, capacity, rounds))],
                                             SLOTS)
    # at most ``capacity`` rows go to the one task that solves the program
    table = (counts.groupBy("length").agg(F.sum("n").alias("n")).repartition(1)
             .mapInArrow(solve, ", ".join(f"{c} long" for c in SLOTS)).toArrow())
    slots = spark.sparkContext.broadcast([table[c].to_numpy() for c in SLOTS])

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = (pieces.withColumn("place", place).join(first, ["length", "bucket"])
              .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                      (F.col("first") + F.col("place")).alias("rank")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, copies, sequence, offset = slots.value
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        want = (length << RANK_BITS) + rank
        at = np.searchsorted(key, want, side="right") - 1
        nth = want - key[at]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence[at] + nth // copies[at]),
             pa.array(offset[at] + nth % copies[at] * length)],
            [*batch.schema.names[:5], "sequence_id", "offset"])
    id_type = df.schema[id_col].dataType.simpleString()
    return arrow_map(ranked, run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
