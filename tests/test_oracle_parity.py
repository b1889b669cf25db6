"""Spark vs the DuckDB oracle on the smallest scale factor (a subset of
keys; the full set is run by tools/oracle_check.py)."""
import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.oracle_check import digest
from wardlens.sources.tables import DRIVER_TABLES

KEYS = ["q01_department_mortality", "q02_readmissions", "q08_cohort_first_week", "q16_surge_months",
        "q26_peak_lag", "i5_department_efficiency", "k0e_enrich_master", "eda_hist", "eda_kde_los_by_outcome",
        "l01_htn_vs_outcome_chi2", "l13_los_by_age_bucket_kruskal", "r3_sim_topk", "p1_monthly_series",
        "j1_los_alerts"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(E.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(rel.columns, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mortality_rate" in df.columns
