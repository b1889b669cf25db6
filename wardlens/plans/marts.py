"""The analytical query catalogue over ``fact_admissions`` (q01 … q30).

Every function maps the fact DataFrame (plus parameters) to a DataFrame.
Plan notes that matter at scale:

* grouping is always a hash aggregate with map-side partial aggregation, so a
  hot department/patient is pre-combined before the shuffle;
* per-group statistics are joined back through ``join_small`` (broadcast only
  with a bounded or counted small side);
* global statistics (mean, sd, total) are scalar subqueries, never a
  single-partition window or a cross join;
* per-patient sequences use ``operators.sequence`` (split by patient-day).

Ordering follows the reference's PostgreSQL semantics: ASC puts NULLs last,
DESC puts them first; every LIMIT gets a unique tie-break key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.columns import classify_risk, iso_week_start, month_start, pct
from wardlens.operators.joins import join_small
from wardlens.operators.percentiles import group_percentiles
from wardlens.operators.sequence import dense_rank_within, lag_within



def DEATH():
    return F.col("is_mortality_case")


def LOS():
    return F.col("length_of_stay")


def N():
    """COUNT(*)"""
    return F.count(F.lit(1))


def DEATHS():
    """COUNT(*) FILTER (WHERE is_mortality_case)"""
    return F.count_if(DEATH())


def DEATHS_SUM():
    """SUM(CASE WHEN is_mortality_case THEN 1 ELSE 0 END) (0, never NULL, per row)"""
    return F.sum(F.when(DEATH(), 1).otherwise(0))


WEEKS_BOUND = "one row per ISO week number (<= 53)"
DEPARTMENTS_BOUND = "one row per department"


def _avg2(x=None):
    return F.round(F.avg(LOS() if x is None else x), 2)


def q01_department_mortality(fact: DataFrame) -> DataFrame:
    s = fact.groupBy("department").agg(
        N().alias("total_admissions"), DEATHS().alias("total_deaths"),
        _avg2().alias("avg_los"), pct(DEATHS(), N()).alias("mortality_rate"))
    r = F.col("mortality_rate")
    return (s.withColumn("risk_category", F.when(r > 15, "High Risk")
                         .when(r.between(5, 15), "Moderate Risk").otherwise("Low Risk"))
             .orderBy(r.desc_nulls_first()))


def q02_readmissions(fact: DataFrame, window_days: int = 30) -> DataFrame:
    """Gap to the previous discharge of the same patient; first visits and
    NULL gaps are dropped; a negative gap (overlap) counts as readmission."""
    f = fact.where(F.col("mrd_no").isNotNull())
    f = lag_within(f, "mrd_no", "doa", "admission_id", "dod", "__prev_dod")
    f = f.withColumn("admission_gap", F.date_diff("doa", "__prev_dod")).drop("__prev_dod")
    return (f.where(F.col("admission_gap").isNotNull())
             .withColumn("readmission_status",
                         F.when(F.col("admission_gap") <= window_days, "Readmission Within 30 Days")
                         .otherwise("No Recent Readmission")))


def q03_los_segments(fact: DataFrame) -> DataFrame:
    los = fact.where(LOS().isNotNull()).select("department", "length_of_stay")
    p = group_percentiles(los, "department", "length_of_stay", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    j = join_small(los, p.where(F.col("department").isNotNull()), "department", bound=DEPARTMENTS_BOUND)
    return j.select("department", "length_of_stay",
                    F.when(LOS() <= F.col("p25"), "Short Stay").when(LOS() <= F.col("p50"), "Moderate Stay")
                    .when(LOS() <= F.col("p75"), "Extended Stay").otherwise("Long Stay").alias("los_category"))


def _weekly_deaths(fact: DataFrame, ma_name: str) -> DataFrame:
    base = fact.groupBy("admission_week").agg(N().alias("total_admissions"), DEATHS().alias("deaths"))
    # <= 53 pre-aggregated rows: an unpartitioned window over them is cheap.
    w = Window.orderBy("admission_week").rowsBetween(-2, 0)
    return base.withColumn(ma_name, F.round(F.avg("deaths").over(w), 2))


def q04_weekly_mortality_ma(fact: DataFrame) -> DataFrame:
    """Weeks are ISO week numbers pooled across years (as in the reference)."""
    return _weekly_deaths(fact, "death_ma_3week").orderBy(F.col("admission_week").asc_nulls_last())


def q05_age_gender_matrix(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("age_bucket", "gender")
            .agg(N().alias("total"), DEATHS_SUM().alias("deaths"), pct(DEATHS_SUM(), N()).alias("mortality_rate"))
            .orderBy(F.col("age_bucket").asc_nulls_last(), F.col("gender").asc_nulls_last()))


def q06_los_outliers(fact: DataFrame, k: float = 2.0) -> DataFrame:
    thr = fact.agg(F.avg(LOS()) + k * F.stddev_samp(LOS())).scalar()
    return fact.where(LOS() > thr).orderBy(LOS().desc_nulls_first(), "admission_id")


def q07_department_year(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("department", F.year("doa").alias("year"))
            .agg(N().alias("admission_count"))
            .orderBy(F.col("department").asc_nulls_last(), F.col("year").asc_nulls_last()))


def q08_cohort_first_week(fact: DataFrame) -> DataFrame:
    """Cohort = smallest week number of the patient.  The fact is first
    pre-aggregated to (patient, week) so a hot patient is <= 53 rows before
    any patient-keyed shuffle."""
    pw = fact.groupBy("mrd_no", "admission_week").agg(N().alias("n"), DEATHS().alias("d"))
    first = pw.groupBy("mrd_no").agg(F.min("admission_week").alias("first_week"))
    c = pw.join(first, "mrd_no")  # inner: NULL patients drop, as in the reference
    return (c.groupBy("first_week")
            .agg(F.sum("n").alias("total_cases"), F.sum("d").alias("deaths"),
                 pct(F.sum("d"), F.sum("n")).alias("mortality_rate"))
            .orderBy(F.col("first_week").asc_nulls_last()))


def q09_pollution_weeks(fact: DataFrame, threshold: float = 100.0) -> DataFrame:
    flags = (fact.where(F.col("pm25").isNotNull()).groupBy("admission_week")
             .agg(F.round(F.avg("pm25"), 2).alias("avg_pm25")))
    c = join_small(fact, flags, "admission_week", bound=WEEKS_BOUND)
    c = c.withColumn("pollution_flag", F.when(F.col("avg_pm25") > threshold, "High Pollution")
                     .otherwise("Normal Pollution"))
    return c.groupBy("pollution_flag").agg(N().alias("total_adm"), _avg2().alias("avg_los"),
                                           pct(DEATHS_SUM(), N()).alias("mortality_rate"))


def q10_top_diagnosis_mortality(fact: DataFrame, min_cases: int = 20, top: int = 10) -> DataFrame:
    g = (fact.groupBy("diagnosis").agg(N().alias("total"), DEATHS().alias("deaths"),
                                       pct(DEATHS(), N()).alias("mortality_rate"))
         .where(F.col("total") >= min_cases))
    return g.orderBy(F.col("mortality_rate").desc_nulls_first(), F.col("diagnosis").asc_nulls_last()).limit(top)


def q11_weekly_z_outliers(fact: DataFrame, z: float = 2.0) -> DataFrame:
    stats = fact.groupBy("admission_week").agg(F.avg(LOS()).alias("mean_los"),
                                               F.stddev_samp(LOS()).alias("stddev_los"))
    j = join_small(fact, stats, "admission_week", bound=WEEKS_BOUND)
    j = j.withColumn("z_score", (LOS() - F.col("mean_los")) / F.nullif(F.col("stddev_los"), F.lit(0.0)))
    return j.where(F.col("z_score") > z).orderBy(F.col("admission_week").asc_nulls_last(),
                                                 F.col("z_score").desc_nulls_first(), "admission_id")


def q12_bottom_decile_los(fact: DataFrame, p: float = 0.1) -> DataFrame:
    pc = group_percentiles(fact, "department", "length_of_stay", {"p10": p})
    j = join_small(fact, pc.where(F.col("department").isNotNull()), "department", bound=DEPARTMENTS_BOUND)
    return (j.where(LOS() <= F.col("p10")).drop("p10")
             .orderBy(F.col("department").asc_nulls_last(), LOS().asc_nulls_last(), "admission_id"))


def q13_patient_risk_index(fact: DataFrame, top: int = 50) -> DataFrame:
    g = fact.groupBy("mrd_no").agg(
        N().alias("admission_count"), F.sum(LOS()).alias("total_los"), DEATHS_SUM().alias("mortality_events"),
        F.round(F.lit(0.5) * F.sum(LOS()) + 10 * DEATHS_SUM(), 2).alias("risk_index"))
    return g.orderBy(F.col("risk_index").desc_nulls_first(), F.col("mrd_no").asc_nulls_last()).limit(top)


def q14_deaths_per_1000_days(fact: DataFrame) -> DataFrame:
    g = fact.groupBy("department").agg(DEATHS().alias("total_deaths"), F.sum(LOS()).alias("total_patient_days"))
    rate = F.round(F.lit(1000.0) * F.col("total_deaths") / F.nullif(F.col("total_patient_days"), F.lit(0)), 2)
    return g.withColumn("deaths_per_1000_days", rate).orderBy(F.col("deaths_per_1000_days").desc_nulls_first())


def q15_recovery_efficiency(fact: DataFrame) -> DataFrame:
    """efficiency = 100 * survivors / mean survivor stay, evaluated as the
    single ratio 100 * survivors * m / s (m, s = count and sum of survivor
    stays) so that only the final value is rounded."""
    alive_los = F.when(DEATH(), F.lit(None)).otherwise(LOS())
    g = fact.groupBy("department").agg(
        F.avg(alive_los).alias("__avg"), F.count_if(~DEATH()).alias("__alive"), N().alias("__n"),
        F.count(alive_los).alias("__m"), F.sum(alive_los).alias("__s"))
    eff = F.lit(100.0) * F.col("__alive") * F.col("__m") / F.nullif(F.col("__s"), F.lit(0))
    return (g.select("department", F.round("__avg", 2).alias("avg_recovery_los"),
                     pct(F.col("__alive"), F.col("__n")).alias("discharge_rate"),
                     F.round(eff, 2).alias("efficiency_score"))
             .orderBy(F.col("efficiency_score").desc_nulls_first()))


def q16_surge_months(fact: DataFrame, k: float = 2.0) -> DataFrame:
    m = fact.groupBy(month_start("doa").alias("month")).agg(N().alias("admission_count"))
    st = m.agg(F.struct(F.round(F.avg("admission_count"), 2).alias("a"),
                        F.round(F.stddev_samp("admission_count"), 2).alias("s"))).scalar()
    out = m.withColumn("overall_avg", st.getField("a")).withColumn("overall_std", st.getField("s"))
    surge = F.col("admission_count") > F.col("overall_avg") + k * F.col("overall_std")
    return out.withColumn("surge_flag", F.when(surge, "Surge Month").otherwise("Normal")) \
              .orderBy(F.col("month").asc_nulls_last())


def q17_age_pollution(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("age_bucket", "pollution_category")
            .agg(N().alias("total_adm"), _avg2().alias("avg_los"), pct(DEATHS(), N()).alias("mortality_rate"))
            .orderBy(F.col("age_bucket").asc_nulls_last(), F.col("pollution_category").asc_nulls_last()))


def q18_weekly_features(fact: DataFrame) -> DataFrame:
    return (fact.groupBy(iso_week_start("doa").alias("week_start"))
            .agg(N().alias("admissions"), _avg2().alias("avg_los"), DEATHS().alias("deaths"),
                 pct(DEATHS(), N()).alias("mortality_rate"))
            .orderBy(F.col("week_start").asc_nulls_last()))


def q19_patient_timeline(fact: DataFrame) -> DataFrame:
    f = fact.select("mrd_no", "doa", "dod", "department", "is_mortality_case")
    return dense_rank_within(f, "mrd_no", "doa", "admission_sequence") \
        .orderBy(F.col("mrd_no").asc_nulls_last(), "admission_sequence")


def q20_high_risk_elderly(fact: DataFrame, min_age: int = 70, min_los: int = 10,
                          category: str = "Severe") -> DataFrame:
    return (fact.where((F.col("age") >= min_age) & (DEATH() == F.lit(True)) & (LOS() >= min_los)
                       & (F.col("pollution_category") == category))
            .orderBy(LOS().desc_nulls_first(), "admission_id"))


def q21_department_risk_clusters(fact: DataFrame) -> DataFrame:
    b = fact.groupBy("department").agg(_avg2().alias("avg_los"), pct(DEATHS_SUM(), N()).alias("mortality_rate"))
    a, r = F.col("avg_los"), F.col("mortality_rate")
    cl = (F.when((a > 10) & (r > 10), "Critical").when(a > 10, "High LOS")
          .when(r > 10, "High Mortality").otherwise("Normal"))
    return b.withColumn("risk_cluster", cl).orderBy("risk_cluster")


def q22_week_over_week(fact: DataFrame) -> DataFrame:
    dw = fact.groupBy("department", "admission_week").agg(N().alias("adm_count"))
    # Window over pre-aggregated rows: <= 53 rows per department.
    w = Window.partitionBy("department").orderBy("admission_week")
    d = dw.withColumn("week_diff", F.col("adm_count") - F.lag("adm_count").over(w))
    return (d.where(F.col("week_diff").isNotNull())
             .orderBy(F.col("department").asc_nulls_last(), F.col("admission_week").asc_nulls_last()))


def q23_gender_age_contribution(fact: DataFrame) -> DataFrame:
    g = fact.groupBy("gender", "age_bucket").agg(
        N().alias("total"), DEATHS_SUM().alias("deaths"), pct(DEATHS_SUM(), N()).alias("mortality_rate"))
    total = fact.agg(DEATHS_SUM()).scalar()
    share = F.round(F.col("deaths") * F.lit(1.0) / F.nullif(total, F.lit(0)), 4)
    return g.withColumn("contribution_pct", share).orderBy(F.col("mortality_rate").desc_nulls_first())


def q24_year_pollution_los(fact: DataFrame) -> DataFrame:
    return (fact.where(F.col("pollution_category").isNotNull())
            .groupBy(F.year("doa").alias("year"), "pollution_category")
            .agg(N().alias("total_cases"), _avg2().alias("avg_los"))
            .orderBy(F.col("year").asc_nulls_last(), F.col("pollution_category").asc_nulls_last()))


def q25_diagnosis_p90(fact: DataFrame, min_cases: int = 20, top: int = 15) -> DataFrame:
    g = (fact.where(F.col("diagnosis").isNotNull()).groupBy("diagnosis")
         .agg(N().alias("total"), _avg2().alias("avg_los"),
              F.round(F.percentile(LOS(), 0.9), 2).alias("p90_los"))
         .where(F.col("total") >= min_cases))
    return g.orderBy(F.col("p90_los").desc_nulls_first(), "diagnosis").limit(top)


def q26_peak_lag(fact: DataFrame) -> DataFrame:
    ws = fact.groupBy("department", "admission_week").agg(N().alias("total"), DEATHS().alias("deaths"))
    # Both windows see <= 53 pre-aggregated rows per department.
    r = (ws.withColumn("adm_peak", F.rank().over(Window.partitionBy("department").orderBy(F.desc("total"))))
           .withColumn("death_peak", F.rank().over(Window.partitionBy("department").orderBy(F.desc("deaths")))))
    a = F.max(F.when(F.col("adm_peak") == 1, F.col("admission_week")))
    d = F.max(F.when(F.col("death_peak") == 1, F.col("admission_week")))
    return (r.groupBy("department").agg(a.alias("admission_peak_week"), d.alias("mortality_peak_week"),
                                        (d - a).alias("lag_weeks"))
             .orderBy(F.col("lag_weeks").desc_nulls_last()))


def q27_patient_summary(fact: DataFrame) -> DataFrame:
    g = fact.groupBy("mrd_no").agg(
        F.min("doa").alias("first_adm"), F.max("dod").alias("last_disch"), N().alias("admission_count"),
        F.sum(LOS()).alias("total_stay"), F.max(DEATH().cast("int")).alias("ever_died"))
    return (g.withColumn("visit_type", F.when(F.col("admission_count") > 1, "Repeat Visitor")
                         .otherwise("Single Admission"))
             .orderBy(F.col("total_stay").desc_nulls_first(), "mrd_no"))


def q28_pm25_bands(fact: DataFrame) -> DataFrame:
    from wardlens.functions.columns import pm25_band
    b = fact.where(F.col("pm25").isNotNull()).withColumn("pm25_band", pm25_band("pm25"))
    return (b.groupBy("pm25_band").agg(N().alias("total_cases"), _avg2().alias("avg_los"),
                                      pct(DEATHS_SUM(), N()).alias("mortality_rate"))
             .orderBy(F.col("mortality_rate").desc_nulls_first()))


def q29_median_iqr(fact: DataFrame) -> DataFrame:
    p = group_percentiles(fact.where(F.col("department").isNotNull()), "department", "length_of_stay",
                          {"p25": 0.25, "median_los": 0.5, "p75": 0.75})
    return (p.select("department", "median_los", (F.col("p75") - F.col("p25")).alias("iqr"))
             .orderBy(F.col("iqr").desc_nulls_first()))


def q30_time_to_death(fact: DataFrame) -> DataFrame:
    dc = (fact.where(DEATH() == F.lit(True)).groupBy("mrd_no")
          .agg(F.min("doa").alias("first_adm"), F.max("dod").alias("last_disch")))
    t = (dc.where(F.col("last_disch").isNotNull() & F.col("first_adm").isNotNull())
           .select(F.date_diff("last_disch", "first_adm").alias("time_to_death")))
    return t.groupBy("time_to_death").agg(N().alias("case_count")).orderBy("time_to_death")


# --- views, functions, procedures ------------------------------------------------

def i1_high_risk_admissions(fact: DataFrame, min_los: int = 15) -> DataFrame:
    return fact.where((LOS() > min_los) | (DEATH() == F.lit(True)))


def i2_classify_admissions(fact: DataFrame) -> DataFrame:
    return fact.select("admission_id", "length_of_stay", "is_mortality_case",
                       classify_risk("length_of_stay", "is_mortality_case").alias("risk_class"))


def register_sql_functions(spark) -> None:
    """SQL surface: the scalar function ``classify_risk(los, died)``.  Department
    efficiency has no SQL function; ``i5_department_efficiency`` is its DataFrame form."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION classify_risk(length_of_stay INT, is_mortality BOOLEAN)
        RETURNS STRING
        RETURN CASE WHEN is_mortality THEN 'Critical'
                    WHEN length_of_stay >= 15 THEN 'High'
                    WHEN length_of_stay BETWEEN 7 AND 14 THEN 'Moderate'
                    ELSE 'Low' END""")


def i3_monthly_summary(fact: DataFrame) -> DataFrame:
    return (fact.groupBy(month_start("doa").alias("summary_month"))
            .agg(N().cast("int").alias("total_admissions"), _avg2().alias("avg_los"),
                 pct(DEATHS_SUM(), N()).alias("mortality_rate")))


def sp_generate_monthly_summary(fact: DataFrame, path: str) -> DataFrame:
    """Procedure: rebuild the monthly summary table.  Whole-table overwrite
    makes a second run idempotent (the reference's append violates its PK)."""
    i3_monthly_summary(fact).write.mode("overwrite").parquet(path)
    return fact.sparkSession.read.parquet(path)


def i4_department_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy("department").agg(N().alias("total_admissions"), _avg2().alias("avg_los"),
                                          DEATHS().alias("deaths"), pct(DEATHS(), N()).alias("mortality_rate"))


def i5_department_efficiency(fact: DataFrame, dept: str | None = None) -> DataFrame:
    """Efficiency = 100 * survivors / mean stay of all stays, one row per
    department (all departments when ``dept`` is None).  Computed as the
    single ratio 100 * survivors * m / s (m, s = count and sum of stays)."""
    f = fact if dept is None else fact.where(F.col("department") == dept)
    g = f.groupBy("department").agg(
        _avg2().alias("avg_los"), pct(DEATHS_SUM(), N()).alias("mortality_rate"),
        F.sum(F.when(~DEATH(), 1).otherwise(0)).alias("__alive"), F.count(LOS()).alias("__m"),
        F.sum(LOS()).alias("__s"))
    eff = F.lit(100.0) * F.col("__alive") * F.col("__m") / F.nullif(F.col("__s"), F.lit(0))
    return g.select("department", "avg_los", "mortality_rate", F.round(eff, 2).alias("efficiency_score"))


def i6_weekly_mortality_view(fact: DataFrame) -> DataFrame:
    return _weekly_deaths(fact, "death_ma")
