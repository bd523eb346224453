"""Plan shape of every registered query: no cross products or nested-loop
joins, one Arrow step per cleaning pass chain, pruned scans."""

import pytest

from conftest import SF001
from mailsift.plans.registry import queries

QUERIES = queries()
# Model queries fit a model while being built; their plans are the scoring side.
SLOW = {"mod1_logreg_bow", "mod2_decision_tree_bow", "mod3_embedding_mlp", "mod6_holdout_report",
        "evl1_batch_scoring", "snk3_model_roundtrip", "snk4_report_roundtrip", "str1_stream_scoring",
        "str2_running_confusion"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_cross_products(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["cln13_clean_text", "cln16_clean_twice", "fea1_vocabulary_cleaned"])
def test_one_python_step_per_branch(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    # One Arrow step per scan branch: the cleaner is never evaluated twice.
    assert plan.count("ArrowEvalPython") == plan.count("FileScan parquet [doc_id") or \
        plan.count("ArrowEvalPython") == 1


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["agg1_rows_per_label"](spark, SF001))
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]
