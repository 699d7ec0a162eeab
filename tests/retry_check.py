"""Run with its own session (``local[4,4]``: up to four attempts per task):
every task of the input stage fails on its first attempt, and the operators'
results must equal a run without failures."""

import json
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from divspark.functions.text import order_key  # noqa: E402
from divspark.operators.assembly import first_wins, ordered_union  # noqa: E402
from divspark.operators.outliers import centroid_distance, hints_per_seed  # noqa: E402
from divspark.operators.ranking import rank_within  # noqa: E402
from divspark.operators.sampling import sample_fraction, stratified_sample  # noqa: E402
from divspark.session import get_session  # noqa: E402
from divspark.plans.standins import round0  # noqa: E402


def flaky(batches):
    from pyspark import TaskContext

    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("injected task loss")
    yield from batches


def results(spark, sf, inject):
    r0 = round0(spark, sf)
    if inject:
        r0 = r0.mapInPandas(flaky, r0.schema)
    out = {}
    d = r0.select("doc_id", "run", "label", "text", "seed")
    out["stratified"] = sorted(r["doc_id"] for r in stratified_sample(d, ["run"], 3, tie=["doc_id"]).collect())
    order = [order_key("text", "p").asc(), F.col("doc_id").asc()]
    out["positions"] = sorted((r["doc_id"], r["position"]) for r in
                              rank_within(d, [], order, rank_col="position").collect())
    out["fraction"] = sorted(r["doc_id"] for r in sample_fraction(d, ["run"], 0.3, tie=["doc_id"]).collect())
    fw = first_wins(ordered_union([d, d.withColumn("label", F.col("label") + 1)]), ["run"], carry=("label",))
    out["first_wins"] = sorted((r["run"], r["text"], r["label"], r["priority"]) for r in fw.collect())
    o = centroid_distance(r0, ["run"])
    out["hints"] = sorted((r["run"], r["seed"], r["hint_rank"], r["hint"][:40])
                          for r in hints_per_seed(o, r0, ["run"], 3).collect())
    return out


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = get_session(master="local[4,4]", shuffle_partitions=4)
    clean = results(spark, sf, inject=False)
    failed = results(spark, sf, inject=True)
    print(json.dumps({k: clean[k] == failed[k] for k in clean}))
