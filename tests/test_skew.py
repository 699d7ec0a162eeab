"""Hot keys measured, not assumed: one text / one label holds a third of the
rows, and the reduce-side tasks of the operator must not receive them.

Task metrics come from Spark's event log (written to a scratch folder by the
test session); each check runs under its own job group.
"""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from divspark.operators.assembly import first_wins, ordered_union
from divspark.operators.sampling import stratified_sample
from divspark.session import materialize

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _reduce_reads(spark, group):
    """Shuffle records read per task, per stage, of the jobs in ``group``."""
    log_dir = spark.sparkContext.getConf().get("spark.eventLog.dir").replace("file:", "", 1)
    path = glob.glob(os.path.join(log_dir, "*"))
    app = [p for p in path if spark.sparkContext.applicationId in p][0]
    files = [app] if os.path.isfile(app) else sorted(
        glob.glob(os.path.join(app, "events_*")), key=lambda f: int(os.path.basename(f).split("_")[1]))
    stages, reads = set(), {}
    for f in files:
        for line in open(f, encoding="utf-8"):
            ev = json.loads(line)
            if ev["Event"] == "SparkListenerJobStart" and \
                    ev.get("Properties", {}).get("spark.jobGroup.id") == group:
                stages.update(ev["Stage IDs"])
            elif ev["Event"] == "SparkListenerTaskEnd" and ev["Stage ID"] in stages:
                m = ev.get("Task Metrics") or {}
                r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                reads.setdefault(ev["Stage ID"], []).append(r)
    return reads


def _hot_docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    hot = F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, F.lit("the same answer")).otherwise(F.col("text"))
    return d.select("doc_id", F.col("lang").alias("run"), hot.alias("text"),
                    F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, F.lit("hot")).otherwise(F.col("lang")).alias("label"))


def _input(spark):
    # materialised first: the measured job group holds only the operator's stages
    return materialize(_hot_docs(spark).repartition(8))


def test_first_wins_hot_text_is_combined_map_side(spark):
    d = _input(spark)
    n, hot = d.count() * 3, d.where("label = 'hot'").count() * 3
    spark.sparkContext.setJobGroup("skew_first_wins", "first wins on a hot text")
    out = first_wins(ordered_union([d, d, d]), [], carry=("label",)).collect()
    spark.sparkContext.setJobGroup("none", "")
    assert sum(1 for r in out if r["text"] == "the same answer") == 1
    reads = sum(sum(v) for v in _reduce_reads(spark, "skew_first_wins").values())
    # the hot text's rows (a third) were combined map-side: at most one row per map task reaches the reducers
    assert 0 < reads <= n - hot + 3 * 8


def test_top_k_hot_label_ships_k_per_task(spark):
    d = _input(spark)
    hot = d.where("label = 'hot'").count()
    groups = d.select("run", "label").distinct().count()
    spark.sparkContext.setJobGroup("skew_top_k", "top-k on a hot label")
    s = stratified_sample(d, ["run"], 6, tie=["doc_id"]).collect()
    spark.sparkContext.setJobGroup("none", "")
    assert sum(1 for r in s if r["label"] == "hot") == 6 * 4        # six per run, four runs
    reads = sum(sum(v) for v in _reduce_reads(spark, "skew_top_k").values())
    # the partial WindowGroupLimit ships at most k rows per (group, map task)
    assert 0 < reads <= 6 * 8 * groups and reads < hot / 5


def test_hint_join_linear_for_a_hot_text(spark):
    from divspark.operators.outliers import centroid_distance, hint_candidates_bounded

    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    hot = F.pmod(F.col("vec_id"), F.lit(3)) == 0
    r0 = e.select(F.lit("r").alias("run"), "label", "embedding",
                  F.when(hot, F.lit("the same answer")).otherwise(F.concat(F.lit("t"), F.col("vec_id"))).alias("text"),
                  F.concat(F.lit("s"), F.col("vec_id")).alias("seed"))
    hot_rows = r0.where("text = 'the same answer'").count()
    out = centroid_distance(r0, ["run"])
    cand, _ = hint_candidates_bounded(out, r0, ["run"], 3)
    n_cand = cand.where("text = 'the same answer'").count()
    # the reference's merge would pair every outlier row of the text with every seed of it
    assert hot_rows > 300 and n_cand <= 3 * hot_rows < hot_rows * hot_rows
