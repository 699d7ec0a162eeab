"""Physical-plan properties the scale design relies on."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from divspark.plans import registry as E
from divspark.operators.assembly import first_wins, ordered_union
from divspark.operators.sampling import stratified_sample
from divspark.sources.tables import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_top_k_limits_before_the_shuffle(spark):
    p = plan(stratified_sample(read_table(spark, SF, "documents"), ["source"], 6, label="lang"))
    partial = p.index("WindowGroupLimit")
    assert "Partial" in p[partial:p.index("\n", partial)] or "Partial" in p
    # the partial limit sits below (after, in the printed tree) the exchange
    assert p.index("Exchange") < p.rindex("WindowGroupLimit")


def test_first_wins_aggregates_map_side(spark):
    d = read_table(spark, SF, "documents").select(F.col("lang").alias("run"), "text", F.lit(1).alias("label"))
    p = plan(first_wins(ordered_union([d, d]), ["run"], carry=("label",)))
    assert "partial_min" in p and "Window" not in p


def test_tokeniser_runs_once(spark):
    p = plan(E.queries()["word_freq"](spark, SF))
    assert p.count("regexp_extract_all") == 1


def test_scan_pushdown_and_pruning(spark):
    df = read_table(spark, SF, "documents").where(F.col("lang") == "en").select("doc_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


@pytest.mark.parametrize("name", sorted(set(E.queries()) - {"classifier_scores", "classifier_svc", "taboo_words", "svm_vocabulary", "svm_coefficients", "svm_certificates",
                                                           "augment_flow", "csv_roundtrip",
                                                           "layout_read", "stored_responses_parse"}))
def test_no_pair_joins(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p          # no row-at-a-time Python UDF
