"""Plans that must stay as they are."""

import os

import pytest

from eventloom.plans import queries as plans

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_scans_are_pruned(spark):
    p = plan(plans.QUERIES["q_dedup_url"](spark, DIR))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan(plans.QUERIES["q_crawl_bfs"](spark, DIR))


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(plans.QUERIES["q_trending_topn"](spark, DIR))


@pytest.mark.parametrize("name", ["q_upsert_merge", "q_change_detection", "q_recommend", "q_query_overlap", "q_user_profile", "q_rrf_fusion", "q_homepage"])
def test_no_cross_join(spark, name):
    p = plan(plans.QUERIES[name](spark, DIR))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["q_rank_six_term", "q_bm25_topk", "q_user_profile", "q_domain_trust", "q_taxonomy_counts"])
def test_no_python_in_the_hot_path(spark, name):
    p = plan(plans.QUERIES[name](spark, DIR))
    assert not any(x in p for x in ("EvalPython", "PythonUDF", "InPandas", "MapInArrow", "pythonUDF"))
