"""Percentiles by selection, imputation, and statistics from counts against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.operators.order_stats import column_percentiles, percentiles
from wardlens.operators.profile import numeric_describe
from wardlens.plans.hypothesis import ks_normal, normal_cdf
from wardlens.plans.modelling import roc_auc

PROBS = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def test_percentiles_per_key(spark):
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(501)] + [("b", float(rng.randint(0, 3))) for _ in range(700)] + [("c", 5.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", PROBS).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for k in got:
        values = [x for key, x in rows if key == k]
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)


def test_percentiles_of_columns_and_of_nothing(spark):
    frame = spark.range(1000).select(F.col("id").alias("u"), (F.col("id") % 7).cast("int").alias("v"), F.lit(None).cast("double").alias("w"))
    got = {r.column_name: (r.p25, r.p50, r.p90) for r in column_percentiles(frame, ["u", "v", "w"], PROBS).collect()}
    assert got == {"u": (249.75, 499.5, pytest.approx(899.1)), "v": (1.0, 3.0, 6.0)}
    wide = {r.column_name: r for r in numeric_describe(frame).collect()}
    assert wide["w"].p50 is None and wide["w"]["count"] == 0 and wide["u"].p75 == 749.25
    none = percentiles(frame.where("u < 0"), [], "u", PROBS).collect()
    assert len(none) == 1 and none[0].p50 is None


def test_normal_cdf_and_ks(spark):
    import math
    z = [-9.0, -7.5, -3.0, -1.0, 0.0, 0.3, 2.5, 6.0, 8.5]
    got = [r.f for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z")).alias("f")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], abs=1e-13)
    rng = np.random.default_rng(2)
    x = np.round(rng.exponential(3.0, 800), 1)
    s = np.sort((x - x.mean()) / x.std(ddof=1))
    f = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in s])
    n = len(s)
    want = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    r = ks_normal(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert r.statistic == pytest.approx(want, abs=1e-12) and r.n == n and 0 <= r.p_direct < 1e-4
    assert ks_normal(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").first().statistic is None
    assert ks_normal(spark.createDataFrame([], "x double"), "x").first().statistic is None


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    frame = spark.createDataFrame(rows, "y int, s double")
    assert roc_auc(frame, "y", "s").first().value == pytest.approx(want)
    assert roc_auc(frame.where("y = 1"), "y", "s").first().value is None
