"""Exact deduplication by a tree merge of sorted digest runs.

Method.  Every row becomes a digest entry ``(sha256, check, best row, count)``
of its normalised text.  A *run* is the sorted list of entries of one scan
partition, one entry per digest.  Let ``m`` bits number the runs and ``m``
leading bits of the digest number the homes.  In round ``k`` a run's location
gives up its next ``r`` run bits and takes ``r`` digest bits instead (radix
``2**r`` recursive halving, the binomial exchange): ``2**r`` sorted runs meet
at every location, are merged in one pass and keep one entry per digest.  After
``m / r`` rounds the location is the digest's home and each digest has exactly
one entry.  A digest that a third of all rows share never has more than one
entry per run, so no task sees the group.

*Verified*: the entry carries a second, independent fingerprint (MD5 and the
normalised length); entries merge only when both agree, so a collision of one
hash keeps its texts apart instead of losing one of them.

The results go back down the same tree: final entries to the leaf runs (at most
one row per run and digest), leaf runs to their own rows.  Everything is
DataFrame functions; the text is scanned once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, numbered, pick, read

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _merge(entries: DataFrame) -> DataFrame:
    """One pass over entries sorted by (loc, digest, check): one entry per digest."""
    return (entries.groupBy("loc", "digest", "check")
            .agg(F.min("best").alias("best"), F.sum("n").alias("n")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                radix_bits: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Two texts are equal when identical after deleting the six ASCII white-space
    characters; of equal texts the row with the most code points stays, then
    the smallest id (a null id last), then one of fully repeated rows.  A null
    text counts as empty and all empty texts are one group.  An empty table
    gives an empty result.  Extra columns are ignored.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "exact-dedup")
    homes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(1, math.ceil(math.log2(homes)))
    norm = normalised(F.col("text"))
    rows = ws.store(
        pick(df, doc_id=id_col, text=text_col).select(
            "doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.concat(F.unhex(F.md5(norm)), F.encode(F.length(norm).cast("string"), "utf-8")).alias("check"),
            F.length(F.coalesce("text", F.lit(""))).alias("len"),
            F.pmod(F.spark_partition_id(), F.lit(1 << bits)).alias("run"),
            F.monotonically_increasing_id().alias("row")), "rows")

    # leaf runs: one entry per digest and scan partition
    leaf = ws.store(_merge(rows.select(
        F.col("run").alias("loc"), "digest", "check", F.lit(1).cast("long").alias("n"),
        F.struct((-F.col("len")).alias("neg_len"), F.col("doc_id").isNull().alias("no_id"),
                 "doc_id", "row").alias("best"))), "leaf")

    home = F.conv(F.substring(F.hex("digest"), 1, 6), 16, 10).cast("int")  # 24 leading bits
    home = F.shiftrightunsigned(home, 24 - bits) if bits <= 24 else home
    entries, done = leaf, 0
    while done < bits:
        done = min(bits, done + radix_bits)
        low = bits - done  # run bits that are left
        # high part: the digest bits taken so far; low part: the run bits not yet given up
        loc = (F.shiftleft(F.shiftrightunsigned(home, low), low)
               + F.col("loc").bitwiseAND(F.lit((1 << low) - 1)))
        entries = _merge(entries.withColumn("loc", loc).repartition(homes, "loc")
                         .sortWithinPartitions("loc", "digest", "check"))
    final = ws.store(entries.select("digest", "check", "best", F.col("n").alias("group_size")), "final")

    runs = leaf.select(F.col("loc").alias("run"), "digest", "check").join(final, ["digest", "check"])
    out = rows.join(runs, ["run", "digest", "check"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                      (F.col("row") == F.col("best.row")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all their columns.
    Of rows that agree in id and text exactly one stays."""
    rows, names = numbered(df)
    id_, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    kept = (exact_dedup(df, id_col, text_col).where("kept").select("doc_id", "text_sha256").distinct())
    own = rows.withColumn("sha", F.sha2(normalised(F.col(text)), 256))
    joined = own.join(kept, own[id_].eqNullSafe(kept["doc_id"]) & (own["sha"] == kept["text_sha256"]))
    # longest original first: equal ids with equal normalised texts may differ in white space
    place = F.row_number().over(Window.partitionBy(id_, "sha").orderBy(
        F.length(F.coalesce(text, F.lit(""))).desc(), F.xxhash64(*names)))
    return joined.withColumn("place", place).where("place = 1").select(*names).toDF(*df.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
