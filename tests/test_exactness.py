"""Branches that the tables never reach, and operators that must not lose rows."""

import pytest
from pyspark.sql import functions as F

from wardlens.operators.sampling import sample_per_group, stratified_split
from wardlens.plans import marts
from wardlens.plans.similarity import top_similar
from wardlens.streaming.los_alert import alerts


def test_q21_reaches_all_four_branches(spark):
    rows = []
    for name, stay, deaths in (("both", 20, 5), ("stay", 20, 0), ("death", 2, 5), ("none", 2, 0)):
        rows += [(name, stay, i < deaths) for i in range(10)]
    fact = spark.createDataFrame(rows, "department string, length_of_stay int, is_mortality_case boolean")
    got = {r.department: r.risk_cluster for r in marts.q21_department_risk_clusters(fact).collect()}
    assert got == {"both": "Critical", "stay": "High LOS", "death": "High Mortality", "none": "Normal"}


def test_unknown_patient_has_no_neighbours(spark):
    rows = [(i, f"m{i}", 40 + i, 3 + i, 50.0 + i, i % 2) for i in range(6)]
    d = spark.createDataFrame(rows, "admission_id long, mrd_no string, age int, length_of_stay int, pm25 double, mortality_flag int")
    features = ["age", "length_of_stay", "pm25"]
    assert top_similar(d, 99, 3, features).count() == 0
    assert top_similar(d, 2, 3, features).count() == 3


def test_sample_keeps_every_group(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 2000).alias("g"))
    got = sample_per_group(df, "g", ["id"], 1).groupBy("g").count().agg(F.count("*"), F.max("count")).first()
    assert tuple(got) == (2000, 1)


@pytest.mark.parametrize("fraction", [0.2, 0.5])
def test_split_takes_the_smallest_hashes_of_each_label(spark, fraction):
    df = spark.range(1000).select("id", F.when(F.col("id") < 7, 1).otherwise(0).alias("label"))
    got = {r.label: r.n for r in stratified_split(df, "label", ["id"], fraction).where("is_test").groupBy("label")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {0: -(-993 * fraction // 1), 1: -(-7 * fraction // 1)}


def test_alert_without_patient_has_a_message(spark):
    d = spark.createDataFrame([(1, None, 40), (2, "m", 41), (3, "m", 2)], "admission_id long, mrd_no string, length_of_stay int")
    assert {r.message for r in alerts(d).collect()} == {
        "Outlier Detected: LOS = 40 for patient unknown", "Outlier Detected: LOS = 41 for patient m"}
