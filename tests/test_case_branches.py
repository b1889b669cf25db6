"""Every branch of the labelled marts, on small frames: the test tables do not reach all of them."""

from wardlens.plans import marts


def _fact(spark, rows):
    """rows: (department, stay, died, pm25, week)."""
    return spark.createDataFrame(
        [(i, f"p{i}", *r) for i, r in enumerate(rows)],
        "admission_id long, mrd_no string, department string, length_of_stay int, is_mortality_case boolean, "
        "pm25 double, admission_week int")


def test_risk_clusters_have_four_labels(spark):
    rows = []
    for department, stay, deaths in (("a", 20, 5), ("b", 20, 0), ("c", 3, 5), ("d", 3, 0), ("edge", 10, 1)):
        rows += [(department, stay, i < deaths, 50.0, 1) for i in range(10)]
    got = {r["department"]: r["risk_cluster"] for r in marts.q21_department_risk_clusters(_fact(spark, rows)).collect()}
    assert got == {"a": "Critical", "b": "High LOS", "c": "High Mortality", "d": "Normal", "edge": "Normal"}


def test_mortality_strata_have_three_labels(spark):
    rows = []
    for department, deaths in (("low", 0), ("from", 1), ("to", 3), ("high", 4)):
        rows += [(department, 3, i < deaths, 50.0, 1) for i in range(20)]
    got = {r["department"]: r["risk_category"] for r in marts.q01_department_mortality(_fact(spark, rows)).collect()}
    assert got == {"low": "Low Risk", "from": "Moderate Risk", "to": "Moderate Risk", "high": "High Risk"}


def test_pollution_weeks_split_at_the_threshold_and_skip_weeks_without_reading(spark):
    rows = [("a", 4, False, 150.0, 1), ("a", 4, True, None, 1), ("a", 2, False, 100.0, 2), ("a", 9, True, None, 3)]
    got = {r["pollution_flag"]: (r["total_adm"], r["avg_los"], r["mortality_rate"])
           for r in marts.q09_pollution_weeks(_fact(spark, rows)).collect()}
    assert got == {"High Pollution": (2, 4.0, 50.0), "Normal Pollution": (1, 2.0, 0.0)}
