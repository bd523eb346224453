"""Every registered query with an oracle equals its DuckDB SQL (sf0.001);
queries without one return rows."""

import pytest

from conftest import SF001
from oracle_compare import compare, duck
from mailsift.plans.registry import oracle_sql, queries

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, SF001, name, QUERIES[name], ORACLES[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {
    "mod1_logreg_bow", "mod2_decision_tree_bow", "mod3_embedding_mlp", "mod6_holdout_report",
    "evl1_batch_scoring", "snk3_model_roundtrip", "str1_stream_scoring", "str2_running_confusion"}))
def test_rows_only_queries_run(spark, name):
    out = QUERIES[name](spark, SF001)
    assert out.columns and out.count() > 0
