"""Plan-level scale properties of the catalogue (checked with explain)."""

import contextlib
import io

import pytest

import __spark_entry__ as E  # noqa: F401  (registers)
from vigil.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# Queries that write first, checkpoint each stage of a cascade, return counts of what they wrote, or take
# numbering boundaries: their plans need a job, which the README lists.
EAGER = {"append_all", "hub_load", "versioned_rewrite", "stream_append", "run_log", "capped_listing", "cascade_product",
         "cascade_hazard", "map_i2620", "map_i0490", "map_i2810", "map_impfood", "map_fda", "seq_codes", "country_master", "rules_load", "map_fda_dated", "cp949_rules", "bom_export",
         "current_master", "cleared_runs", "snapshot_buckets", "changed_alerts", "folded_audit", "folded_sources"}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_joins_are_equi_joins_and_plans_need_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    group = f"plan-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        plan = _plan(QUERIES[name](spark, SF))
        # the readers' footer jobs are Spark's own
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        jobs = [s.name for s in stages if s and not s.name.startswith(("parquet at", "csv at"))]
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in EAGER or not jobs


@pytest.mark.parametrize("name,needle", [
    ("top_origin", "In(o_orderstatus, [F,O])"),
    ("dash_filter", "In(event_type, [click,purchase])"),
    ("recent_days", "GreaterThanOrEqual(o_orderdate,1998-07-03T00:00)"),
    ("name_rows", "EqualTo(p_type,PROMO)"),
])
def test_filters_reach_the_scan(spark, name, needle):
    plan = _plan(QUERIES[name](spark, SF))
    assert needle in plan
    assert "ReadSchema: struct<" in plan


def test_projection_pruned(spark):
    plan = _plan(QUERIES["hub_load"](spark, SF))
    scans = [l for l in plan.splitlines() if l.startswith("ReadSchema")]
    assert scans == ["ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>"]
