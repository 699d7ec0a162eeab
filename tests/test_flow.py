import os

import pytest
from pyspark.sql import functions as F

from divspark.plans.flow import augment_runs
from divspark.plans.io_queries import echo_paraphraser, hashing_encoder

SF = "/root/testdata/sf0.001"


def upper_entities(texts):
    return [[w for w in t.split() if len(w) > 6][:2] for t in texts]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_augment_runs_end_to_end(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.select(F.col("lang").alias("dataset"), "text",
                        (F.col("doc_id") % 3).cast("int").alias("label"))
    out = augment_runs(train, echo_paraphraser, hashing_encoder, str(tmp_path), keys=("dataset",),
                       entity_fn=upper_entities, ablations=True)
    seeds = out["seeds"]
    per = {r["count"] for r in seeds.groupBy("dataset", "label").count().collect()}
    assert per <= set(range(1, 7)) and 6 in per
    final = out["training_sets"]
    methods = {r["method"] for r in final.select("method").distinct().collect()}
    assert methods == {"prompt", "taboo", "taboo_ablt", "chaining", "chaining_ablt", "hints", "hints_ablt"}
    # every method's set holds round 0 (first wins) and no duplicate texts before dequoting
    assert final.groupBy("dataset", "method", "text").count().where("count > 1").count() == 0
    r0 = out["round0"].select("dataset", "text").distinct().count()
    assert final.where("method = 'taboo'").count() >= r0 * 0.9
    # taboo prompts carry up to three words
    raw = out["raw_round1_taboo"]
    assert raw.where(F.col("prompt").contains("Don’t use the words")).count() > 0
