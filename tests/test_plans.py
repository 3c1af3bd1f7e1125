"""Plan checks: no Python evaluation, filters reach the scan, pruning."""

import pytest

from cohort_spark.plans.catalog import QUERIES
from cohort_spark.session import scratch_path
from cohort_spark.sources import io as IO
from cohort_spark.sources import tables as T_

SMALL = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")
PLAN_ONLY = ["a1_risk_indicators", "a5_action_counts", "l3_evolution", "j1_enrich_requests", "c17_pupil_profile",
             "c15_recommendation", "a10_histogram", "p3_filter_fallback", "n2_coerce_numeric"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_ONLY)
def test_no_python_in_plan(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert not any(p in plan for p in PYTHON_NODES)


def test_orders_scan_is_pruned_and_filtered(spark):
    def scan_of(df):
        return [ln for ln in _plan(df).splitlines() if "FileScan parquet" in ln and "orders" in ln][0]
    one = scan_of(T_.snapshot(spark, SMALL, 1997))  # a snapshot's year reaches the scan
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in one
    whole = scan_of(T_.pupil_year(spark, SMALL))  # the stacked table reads every year
    assert "OrEqual(o_orderdate" not in whole and "LessThan(o_orderdate" not in whole
    assert all("o_orderkey" not in s.split("ReadSchema")[1] for s in (one, whole))


def test_snapshot_read_prunes_partitions(spark):
    path = scratch_path(spark, "snap-test")
    IO.write_snapshots(T_.pupil_year(spark, SMALL), path)
    one = IO.read_snapshot(spark, path, 1997)
    plan = _plan(one)
    assert "PartitionFilters: [isnotnull(ano" in plan and "(ano#" in plan
    with pytest.raises(IO.SnapshotError):
        IO.read_snapshot(spark, path, 2030)
    with pytest.raises(IO.SnapshotError):
        IO.read_snapshot(spark, path + "-missing", 1997)
