"""Queries of the operators that SQL can express, against their oracles."""

import os

import pytest

from divspark.llm import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_matches_oracle(spark, name):
    r = compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert r["columns_match"] and r["values_match"], r


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_operator_runs_over_the_whole_table(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
