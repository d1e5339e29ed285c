"""Plan hygiene: scans read only the needed columns, the native feature path
has no Python, and the look-alike path runs its UDF once per distinct domain."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_scan_is_pruned_and_native(spark):
    plan = _plan(E.queries()["url_features"](spark, SF))
    pages_scans = [l for l in plan.split("\n") if "pages.parquet" in l]
    assert pages_scans and all("ReadSchema: struct<page_id:bigint,url:string>" in l for l in pages_scans)
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_soft_vote_reads_only_order_keys(spark):
    plan = _plan(E.queries()["soft_vote"](spark, SF))
    scans = [l for l in plan.split("\n") if "orders.parquet" in l]
    assert scans and all("ReadSchema: struct<o_orderkey:bigint>" in l for l in scans)
    assert "Exchange" not in plan


def test_ratio_udf_runs_on_distinct_domains(spark):
    plan = _plan(E.queries()["typosquat_profile"](spark, SF))
    assert plan.count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
