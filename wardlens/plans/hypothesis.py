"""Distributed hypothesis tests.

Each test reduces the data to sufficient statistics with Spark aggregates
and returns ONE row with a uniform schema:

    test_id INT, test STRING, kind STRING, statistic DOUBLE,
    df1 DOUBLE, df2 DOUBLE, n BIGINT

``kind`` names the reference distribution (chi2, t, f, r, z) or ``direct``
when the p-value comes with the statistic (KS, Shapiro-Wilk).  ``with_p``
adds ``p_value`` by evaluating the tail on those few result rows.

Semantics follow the usual library defaults: chi-square with Yates'
correction when dof = 1 (empty cells included), pooled-variance t,
one-way ANOVA F, Pearson/Spearman with t(n-2) p-values, Levene centred on
the median, Mann-Whitney U of the first sample with tie-corrected normal
approximation and continuity correction, Kruskal-Wallis H with tie
correction, pooled two-proportion z.  NULLs are dropped pairwise.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.columns import safe_double
from wardlens.functions.tails import p_value, shapiro_w
from wardlens.operators.joins import join_small
from wardlens.operators.order_stats import percentiles
from wardlens.operators.ranks import tie_term, value_ranks
from wardlens.operators.sampling import sample_per_group
from wardlens.session import cut_lineage

RESULT_COLS = ["test_id", "test", "kind", "statistic", "df1", "df2", "n"]

# The columns that the shared pre-step of the test battery coerces, then those in which it drops NULLs.
COERCE = ["duration_of_stay", "age", "urea", "creatinine", "bnp", "tlc", "glucose", "platelets"]
REQUIRED = ["duration_of_stay", "gender", "age", "htn", "ckd", "dm", "outcome", "age_bucket",
            "type_of_admissionemergencyopd"]


def prepare(master: DataFrame) -> DataFrame:
    d = master.withColumns({c: safe_double(c) for c in COERCE if c in master.columns})
    return d.dropna(subset=[c for c in REQUIRED if c in d.columns])


def _row(stats: DataFrame, test_id: int, name: str, kind: str) -> DataFrame:
    def col(c):
        return F.col(c).cast("double") if c in stats.columns else F.lit(None).cast("double")
    return stats.select(F.lit(test_id).cast("int").alias("test_id"), F.lit(name).alias("test"),
                        F.lit(kind).alias("kind"), col("statistic").alias("statistic"),
                        col("df1").alias("df1"), col("df2").alias("df2"), F.col("n").cast("bigint").alias("n"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _attach(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to ``left`` as a scalar subquery
    (evaluated once; no join)."""
    st = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return left.withColumns({c: st.getField(c) for c in one_row.columns})


# --- L1 chi-square test of independence ----------------------------------------------

def chi2_independence(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Pearson chi-square on the a x b contingency table (rows with NULL in
    either column dropped).  Empty cells contribute through the identity
    sum_all(E) = N, so the full r x c grid is never materialised; for the
    2 x 2 case (the only one with Yates' correction) the four expected
    counts come from the min/max margins."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    rm = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cm = cells.groupBy("b").agg(F.sum("o").alias("c"))
    # Margins onto the (already aggregated) cells: a window group holds one
    # row per category of the other column, never raw rows.
    j = cells.withColumn("r", F.sum("o").over(Window.partitionBy("a"))) \
             .withColumn("c", F.sum("o").over(Window.partitionBy("b")))
    tot = cells.agg(F.sum("o")).scalar()
    e = F.col("r") * F.col("c") / tot
    o = F.col("o").cast("double")
    diff = e - o
    o_adj = o + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)
    s = j.agg(F.sum((o - e) * (o - e) / e).alias("plain_obs"), F.sum(e).alias("e_obs"),
              F.sum((o_adj - e) * (o_adj - e) / e).alias("yates_obs"),
              F.sum(F.pow(F.least(F.lit(0.5), e) - e, 2) / e).alias("g_obs"))
    m = _attach(s, rm.agg(F.count(F.lit(1)).alias("nr"), F.min("r").alias("r1"), F.max("r").alias("r2")))
    m = _attach(m, cm.agg(F.count(F.lit(1)).alias("nc"), F.min("c").alias("c1"), F.max("c").alias("c2")))
    m = m.withColumn("N", F.lit(tot).cast("double"))

    def g(r, cc):
        ee = F.col(r) * F.col(cc) / F.col("N")
        return F.pow(F.least(F.lit(0.5), ee) - ee, 2) / ee
    g_all = g("r1", "c1") + g("r1", "c2") + g("r2", "c1") + g("r2", "c2")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    plain = F.col("plain_obs") + (F.col("N") - F.col("e_obs"))
    corrected = F.col("yates_obs") + (g_all - F.col("g_obs"))
    stat = F.when((dof == 1) & F.lit(yates), corrected).otherwise(plain)
    return m.select(stat.alias("statistic"), dof.cast("double").alias("df1"), F.col("N").cast("bigint").alias("n"))


# --- L2 two-sample t ------------------------------------------------------------------

def ttest_ind(df: DataFrame, value: str, cond1, cond2) -> DataFrame:
    """Pooled-variance two-sample t of ``value`` between two row subsets."""
    x = F.col(value).cast("double")
    x1, x2 = F.when(_c(cond1), x), F.when(_c(cond2), x)
    s = df.agg(F.count(x1).alias("n1"), F.avg(x1).alias("m1"), F.var_samp(x1).alias("v1"),
               F.count(x2).alias("n2"), F.avg(x2).alias("m2"), F.var_samp(x2).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(sp2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return s.select(t.alias("statistic"), dof.cast("double").alias("df1"), (F.col("n1") + F.col("n2")).alias("n"))


# --- L3 one-way ANOVA -------------------------------------------------------------------

def _anova_from(d: DataFrame, group: str, x: Column) -> DataFrame:
    g = d.groupBy(group).agg(F.count(x).alias("ng"), F.avg(x).alias("mg"), F.var_samp(x).alias("vg")) \
         .where(F.col("ng") > 0)
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("ng").alias("N"),
              (F.sum(F.col("ng") * F.col("mg")) / F.sum("ng")).alias("gm"),
              F.sum(F.coalesce((F.col("ng") - 1) * F.col("vg"), F.lit(0.0))).alias("ssw"))
    gm = s.select("gm").scalar()
    ssb = g.agg(F.sum(F.col("ng") * (F.col("mg") - gm) * (F.col("mg") - gm)).alias("ssb"))
    j = _attach(s, ssb)
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("N") - F.col("k")))
    return j.select(f.alias("statistic"), (F.col("k") - 1).cast("double").alias("df1"),
                    (F.col("N") - F.col("k")).cast("double").alias("df2"), F.col("N").alias("n"))


def anova_oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    return _anova_from(d, group, F.col(value).cast("double"))


# --- L4 / L5 correlation tests ------------------------------------------------------------

def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("statistic"),
              F.count(F.lit(1)).alias("n"))
    return s.select("statistic", (F.col("n") - 2).cast("double").alias("df1"), "n")


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rho = Pearson correlation of average ranks, computed on
    (x, y, count) triples — raw rows are never windowed."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    rx = value_ranks(pairs.groupBy("x").agg(F.sum("w").alias("cnt")), "x").select("x", F.col("rank").alias("rx"))
    ry = value_ranks(pairs.groupBy("y").agg(F.sum("w").alias("cnt")), "y").select("y", F.col("rank").alias("ry"))
    j = join_small(join_small(pairs, rx, "x"), ry, "y")
    w = F.col("w").cast("double")
    s = j.agg(F.sum(w).alias("W"), F.sum(w * F.col("rx")).alias("sx"), F.sum(w * F.col("ry")).alias("sy"),
              F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(w * F.col("ry") * F.col("ry")).alias("syy"),
              F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"))
    W = F.col("W")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / W
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / W
    vy = F.col("syy") - F.col("sy") * F.col("sy") / W
    return s.select((cov / F.sqrt(vx * vy)).alias("statistic"), (W - 2).alias("df1"), W.cast("bigint").alias("n"))


# --- L7 Levene (median-centred) -----------------------------------------------------------

def levene(df: DataFrame, value: str, group: str, groups=None) -> DataFrame:
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    if groups is not None:
        d = d.where(F.col(group).isin(list(groups)))
    med = percentiles(d, group, value, {"med": 0.5})
    j = join_small(d, med, group, bound="one row per compared group")
    return _anova_from(j, group, F.abs(F.col(value).cast("double") - F.col("med")))


# --- L8 Kolmogorov-Smirnov vs N(0, 1) of z-scores ---------------------------------------------

def normal_cdf(z: Column, terms: int = 160) -> Column:
    """The distribution function of N(0, 1) by its series of odd powers, within rounding up to 8 deviations, 0 or 1 beyond."""
    x = F.least(F.abs(z), F.lit(8.0))
    start = F.struct(x.alias("term"), x.alias("total"))
    # Each term is the one before times x^2 over the next odd number.
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda a, k: F.struct(
        (a["term"] * x * x / (2 * k + 1)).alias("term"), (a["total"] + a["term"] * x * x / (2 * k + 1)).alias("total")), lambda a: a["total"])
    half = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < -8, F.lit(0.0)).when(z > 8, F.lit(1.0)).otherwise(0.5 + F.signum(z) * half)


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """One-sample KS of the standardised values (sd with n-1) against N(0, 1).

    The largest gap lies at a distinct value, before or after its step, so
    prefix counts of the distinct values are enough; p is Kolmogorov's limit
    with Stephens' correction for n.  With equal values only there is no
    statistic.
    """
    x = F.col(value).cast("double")
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("cnt")))
    # Three numbers pass the driver: a subquery cannot stand inside the series.
    mean = F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt")
    n, m = counts.agg(F.sum("cnt"), mean).first()
    square = counts.agg(F.sum((F.col("x") - F.lit(m)) ** 2 * F.col("cnt")) / F.nullif(F.lit(n) - 1, F.lit(0))).first()[0] if n else None
    n, z = F.lit(n).cast("bigint"), (F.col("x") - F.lit(m).cast("double")) / F.lit(math.sqrt(square) if square else None).cast("double")
    before = F.col("rank") - (F.col("cnt") + 1) / 2.0
    d = value_ranks(counts, "x").select((before / n).alias("lo"), ((before + F.col("cnt")) / n).alias("hi"), normal_cdf(z).alias("f"))
    r = d.agg(F.max(F.greatest(F.col("hi") - F.col("f"), F.col("f") - F.col("lo"))).alias("statistic")).select("statistic", n.alias("n"))
    t = (F.sqrt(F.col("n")) + 0.12 + 0.11 / F.sqrt(F.col("n"))) * F.col("statistic")
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t))
    return r.select("statistic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)).alias("p_direct"), "n")


# --- L9 Mann-Whitney U, L10 Kruskal-Wallis H ----------------------------------------------------

def _group_rank_sums(d: DataFrame, value: str, group: str):
    gv = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("cnt"))
    vc = gv.groupBy(value).agg(F.sum("cnt").alias("cnt"))
    ranks = value_ranks(vc, value).select(value, "rank")
    rs = join_small(gv, ranks, value).groupBy(group).agg(
        F.sum(F.col("cnt") * F.col("rank")).alias("R"), F.sum("cnt").alias("ng"))
    return rs, tie_term(vc)


def mann_whitney(df: DataFrame, value: str, cond1, cond2) -> DataFrame:
    """U of the first sample; p from the tie-corrected normal approximation
    with continuity correction (two-sided), reported as a z statistic."""
    g = F.when(_c(cond1), F.lit(1)).when(_c(cond2), F.lit(2))
    d = df.where(F.col(value).isNotNull()).select(g.alias("g"), F.col(value).cast("double").alias("v")) \
          .where(F.col("g").isNotNull())
    rs, ties = _group_rank_sums(d, "v", "g")
    s = rs.agg(F.sum(F.when(F.col("g") == 1, F.col("R"))).alias("R1"),
               F.sum(F.when(F.col("g") == 1, F.col("ng"))).cast("double").alias("n1"),
               F.sum(F.when(F.col("g") == 2, F.col("ng"))).cast("double").alias("n2"))
    s = _attach(s, ties)
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("R1") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - mu - 0.5) / sigma
    return s.select(u1.alias("statistic"), z.alias("z"), n.cast("bigint").alias("n"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    rs, ties = _group_rank_sums(d, "v", "g")
    s = rs.agg(F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("q"), F.sum("ng").cast("double").alias("N"),
               F.count(F.lit(1)).alias("k"))
    s = _attach(s, ties)
    N = F.col("N")
    h = (F.lit(12.0) / (N * (N + 1)) * F.col("q") - 3 * (N + 1)) / (1 - F.col("ties") / (N * N * N - N))
    return s.select(h.alias("statistic"), (F.col("k") - 1).cast("double").alias("df1"), N.cast("bigint").alias("n"))


# --- L11 two-proportion z ---------------------------------------------------------------

def two_prop_z(df: DataFrame, success: str, cond1, cond2) -> DataFrame:
    """Pooled two-proportion z: successes = sum of ``success`` per subset,
    observations = rows per subset (NULL successes count as rows)."""
    s = df.agg(F.sum(F.when(_c(cond1), F.col(success))).cast("double").alias("k1"),
               F.sum(F.when(_c(cond2), F.col(success))).cast("double").alias("k2"),
               F.count_if(_c(cond1)).cast("double").alias("n1"), F.count_if(_c(cond2)).cast("double").alias("n2"))
    p = (F.col("k1") + F.col("k2")) / (F.col("n1") + F.col("n2"))
    z = (F.col("k1") / F.col("n1") - F.col("k2") / F.col("n2")) / \
        F.sqrt(p * (1 - p) * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return s.select(z.alias("statistic"), (F.col("n1") + F.col("n2")).cast("bigint").alias("n"))


# --- L6 Shapiro-Wilk on a seeded sample per group -----------------------------------------------

SHAPIRO_SCHEMA = T.StructType([T.StructField("grp", T.StringType()), T.StructField("statistic", T.DoubleType()),
                               T.StructField("p_direct", T.DoubleType()), T.StructField("n", T.LongType())])


def shapiro(df: DataFrame, value: str, id_cols, by: str | None = None, sample: int = 500,
            seed: int = 42) -> DataFrame:
    """W and p per group on min(500, n) rows chosen by hash order; each group
    is tested in its own ``applyInPandas`` call (<= 500 rows per call)."""
    g = F.col(by).cast("string") if by else F.lit("all")
    d = df.where(F.col(value).isNotNull()).select(g.alias("grp"), F.col(value).cast("double").alias("x"),
                                                  *[F.col(c) for c in id_cols])
    s = sample_per_group(d, "grp", id_cols, sample, seed).select("grp", "x")

    def w(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, p = shapiro_w(pdf["x"].to_numpy())
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "statistic": [stat], "p_direct": [p],
                             "n": [len(pdf)]})
    return s.groupBy("grp").applyInPandas(w, SHAPIRO_SCHEMA)


# --- p-values for result rows -------------------------------------------------------------

def with_p(results: DataFrame) -> DataFrame:
    """Add ``p_value`` to test result rows (a handful of rows; Arrow batch)."""
    @F.pandas_udf(T.DoubleType())
    def _p(kind: pd.Series, stat: pd.Series, df1: pd.Series, df2: pd.Series, direct: pd.Series) -> pd.Series:
        out = []
        for k, s, a, b, pd_ in zip(kind, stat, df1, df2, direct):
            if k == "direct":
                out.append(pd_)
            else:
                out.append(p_value(k, None if pd.isna(s) else float(s),
                                   None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)))
        return pd.Series(out, dtype="float64")
    direct = F.col("p_direct") if "p_direct" in results.columns else F.lit(None).cast("double")
    z = F.coalesce(F.col("z"), F.col("statistic")) if "z" in results.columns else F.col("statistic")
    return results.withColumn("p_value", _p(F.col("kind"), z, F.col("df1"), F.col("df2"), direct))


# --- the named test battery -----------------------------------------------------------------

def battery(master: DataFrame) -> dict[str, "callable"]:
    """The named tests with a SQL-checkable statistic, keyed ``l{nn}_<name>``;
    each value builds its one-row result when called (plans are only
    constructed for the tests actually requested)."""
    d = prepare(master)
    death, alive = F.col("outcome") == "DEATH", F.col("outcome") != "DEATH"
    male, female = F.col("gender") == "M", F.col("gender") == "F"
    los = "duration_of_stay"
    t = {}

    def add(i, name, kind, build, extra=()):
        def run():
            frame = build()
            r = _row(frame, i, name, kind)
            for c in extra:
                r = r.withColumn(c, frame.select(c).scalar())
            return r
        t[f"l{i:02d}_{name}"] = run

    add(1, "htn_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "htn", "outcome"))
    add(2, "los_by_gender_ttest", "t", lambda: ttest_ind(d, los, male, female))
    add(3, "los_by_ckd_ttest", "t", lambda: ttest_ind(d, los, F.col("ckd") == 1, F.col("ckd") == 0))
    add(4, "los_by_age_bucket_anova", "f", lambda: anova_oneway(d, los, "age_bucket"))
    add(5, "admission_type_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "type_of_admissionemergencyopd", "outcome"))
    add(6, "los_vs_age_pearson", "r", lambda: pearson_test(d, los, "age"))
    add(10, "los_by_gender_levene", "f", lambda: levene(d, los, "gender", ["M", "F"]))
    add(12, "los_by_ckd_mannwhitney", "z", lambda: mann_whitney(d, los, F.col("ckd") == 1, F.col("ckd") == 0), ["z"])
    add(13, "los_by_age_bucket_kruskal", "chi2", lambda: kruskal(d, los, "age_bucket"))
    add(14, "smoking_by_death_prop_z", "z", lambda: two_prop_z(d, "smoking", death, alive))
    add(15, "dm_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "dm", "outcome"))
    add(16, "glucose_by_death_ttest", "t", lambda: ttest_ind(d, "glucose", death, alive))
    add(17, "platelets_by_age_bucket_anova", "f", lambda: anova_oneway(d, "platelets", "age_bucket"))
    add(18, "gender_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "gender", "outcome"))
    add(19, "bnp_vs_los_spearman", "r", lambda: spearman_test(d, "bnp", los))
    add(20, "los_by_shock_ttest", "t", lambda: ttest_ind(d, los, F.col("shock") == 1, F.col("shock") == 0))
    add(21, "icu_stay_by_death_ttest", "t", lambda: ttest_ind(d, "duration_of_intensive_unit_stay", death, alive))
    add(22, "af_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "af", "outcome"))
    add(23, "age_bucket_vs_ckd_chi2", "chi2", lambda: chi2_independence(d, "age_bucket", "ckd"))
    add(24, "hfref_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "hfref", "outcome"))
    add(25, "stemi_vs_outcome_chi2", "chi2", lambda: chi2_independence(d, "stemi", "outcome"))
    return t


def direct_tests(master: DataFrame) -> dict[str, "callable"]:
    """Tests whose p-value is computed with the statistic (no SQL oracle)."""
    d = prepare(master)

    def ks():
        r = ks_normal(d, "duration_of_stay")
        return _row(r, 11, "los_ks_normal", "direct").withColumn("p_direct", r.select("p_direct").scalar())

    def sw(i, c, name):
        def run():
            r = shapiro(d, c, ["sno"])
            return _row(r, i, name, "direct").withColumn("p_direct", r.select("p_direct").scalar())
        return run
    return {"l08_los_shapiro": sw(8, "duration_of_stay", "los_shapiro"),
            "l09_age_shapiro": sw(9, "age", "age_shapiro"), "l11_los_ks_normal": ks}


def all_tests(master: DataFrame) -> DataFrame:
    """All 24 tests, one row each, with p-values.  Each one-row result is
    materialised (reliable checkpoint) before the union, so the p-value UDF
    reads 24 plain rows."""
    rows = []
    d = cut_lineage(prepare(master))  # shared input of all 24 tests, computed once
    for b in list(battery(d).values()) + list(direct_tests(d).values()):
        f = b()
        for c in ("p_direct", "z"):
            if c not in f.columns:
                f = f.withColumn(c, F.lit(None).cast("double"))
        rows.append(cut_lineage(f.select(*RESULT_COLS, "z", "p_direct")))
    u = rows[0]
    for f in rows[1:]:
        u = u.unionByName(f)
    return with_p(u).drop("p_direct")
