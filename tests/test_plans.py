"""Plan-shape checks: pruning reaches the scan, no cartesian products,
bounded broadcasts where intended, no single-partition exchange over raw rows."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["q01_department_mortality", "q02_readmissions", "q06_los_outliers",
                                 "q08_cohort_first_week", "q11_weekly_z_outliers", "q23_gender_age_contribution",
                                 "eda_kde_los_by_outcome", "r3_sim_topk"])
def test_no_cartesian_or_nested_loop(spark, key):
    p = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(spark):
    p = _plan(E.queries()["q01_department_mortality"](spark, SF_SMALL))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scans, p
    for s in scans:
        assert "l_extendedprice" not in s and "l_partkey" not in s


def test_weekly_stats_are_broadcast(spark):
    p = _plan(E.queries()["q11_weekly_z_outliers"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_patient_sequence_has_no_single_partition_exchange(spark):
    p = _plan(E.queries()["q02_readmissions"](spark, SF_SMALL))
    assert "SinglePartition" not in p
