import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.operators.sampling import sample_per_group, stratified_split
from wardlens.plans.marts import q03_los_segments, q12_bottom_decile_los
from wardlens.plans.hypothesis import chi2_independence, kruskal, ttest_ind


def _chi2_numpy(table, yates):
    t = np.asarray(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    o = t.copy()
    if yates and (t.shape[0] - 1) * (t.shape[1] - 1) == 1:
        d = e - o
        o = o + np.minimum(0.5, np.abs(d)) * np.sign(d)
    return float(((o - e) ** 2 / e).sum())


@pytest.mark.parametrize("table", [[[10, 0], [5, 7]], [[12, 30], [9, 4]], [[3, 0, 4], [0, 6, 2]]])
def test_chi2_matches_dense_formula(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = chi2_independence(df, "a", "b").first()
    assert got.statistic == pytest.approx(_chi2_numpy(table, True), rel=1e-12)
    assert got.df1 == (len(table) - 1) * (len(table[0]) - 1)


def test_pooled_t(spark):
    a, b = [3.0, 4.0, 5.0, 9.0], [1.0, 2.0, 2.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    got = ttest_ind(df, "x", F.col("g") == "a", F.col("g") == "b").first()
    sp2 = ((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / (len(a) + len(b) - 2)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(sp2 * (1 / len(a) + 1 / len(b)))
    assert got.statistic == pytest.approx(t, rel=1e-12)


def test_kruskal_tie_corrected(spark):
    groups = {"x": [1, 2, 2, 5], "y": [2, 3, 8], "z": [5, 9, 9, 9]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = kruskal(df, "v", "g").first().statistic
    allv = sorted(v for vs in groups.values() for v in vs)
    rank = {v: np.mean([i + 1 for i, u in enumerate(allv) if u == v]) for v in set(allv)}
    n = len(allv)
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    ties = sum(c ** 3 - c for c in (allv.count(v) for v in set(allv)))
    assert got == pytest.approx(h / (1 - ties / (n ** 3 - n)), rel=1e-12)


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.range(0, 1000).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    s1 = stratified_split(df, "label", ["id"], 0.2, 42)
    counts = {(r.label, r.is_test): r["count"] for r in s1.groupBy("label", "is_test").count().collect()}
    n1 = df.where("label = 1").count()
    assert counts[(1, True)] == math.ceil(0.2 * n1)
    assert counts[(0, True)] == math.ceil(0.2 * (1000 - n1))
    s2 = stratified_split(df.repartition(7), "label", ["id"], 0.2, 42)
    assert sorted(r.id for r in s1.where("is_test").collect()) == sorted(r.id for r in s2.where("is_test").collect())


def test_no_class_goes_to_one_task(spark):
    df = spark.range(0, 1000).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = stratified_split(df, "label", ["id"], 0.2, 42)
        # A merge join would sort a whole class in one task.
        assert "SortMergeJoin" not in split._jdf.queryExecution().executedPlan().toString()
        fact = df.select(F.col("id").alias("admission_id"), F.col("label").cast("string").alias("department"), (F.col("id") % 30).cast("int").alias("length_of_stay"))
        for q in (q03_los_segments, q12_bottom_decile_los):
            assert "SortMergeJoin" not in q(fact)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sample_per_group_sizes(spark):
    df = spark.range(0, 3000).withColumn("g", F.when(F.col("id") < 2500, "big").otherwise("small"))
    got = {r.g: r["count"] for r in sample_per_group(df, "g", ["id"], 500, 7).groupBy("g").count().collect()}
    assert got == {"big": 500, "small": 500}
