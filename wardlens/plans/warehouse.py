"""Warehouse build: staging -> dimensions + fact, enrichment, profiling,
referential-integrity report.

* Insert-ignore ("first row per key wins") is an aggregate
  (``min_by`` over a deterministic order key), so a key holding a third of
  the rows is pre-combined map-side instead of landing in one window task.
* The pollution dimension is one row per calendar day and joins by
  broadcast.
* Rebuilds are whole-table overwrites, so running a build twice gives the
  same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.columns import age_bucket, is_death_outcome, left_chars, pm25_band
from wardlens.operators import profile as P
from wardlens.operators.joins import join_small
from wardlens.sources.files import coerce_dates, normalize_columns

DAYS_BOUND = "one row per calendar day"
POLLUTANTS = ["pm25", "pm10", "no2", "so2"]


def dim_patient(stg: DataFrame) -> DataFrame:
    """One row per patient key (VARCHAR(20)); the earliest (doa, sno) row wins."""
    s = stg.where(F.col("mrd_no").isNotNull()).select(
        left_chars("mrd_no", 20).alias("mrd_no"), "age", left_chars("gender", 10).alias("gender"), "doa", "sno")
    return s.groupBy("mrd_no").agg(
        F.min_by(F.struct("age", "gender"), F.struct("doa", "sno")).alias("r")
    ).select("mrd_no", "r.age", "r.gender")


def dim_department(stg: DataFrame) -> DataFrame:
    return (stg.where(F.col("type_of_admissionemergencyopd").isNotNull())
            .select(left_chars("type_of_admissionemergencyopd", 100).alias("department")).distinct()
            .withColumn("specialty", F.lit(None).cast("string")))


def dim_pollution(stg: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """One row per admission day; daily pollutant means when readings exist,
    NULL readings and category 'Unknown' otherwise."""
    days = stg.where(F.col("doa").isNotNull()).select(F.col("doa").alias("recorded_date")).distinct()
    if readings is None:
        d = days.select("recorded_date", *[F.lit(None).cast("double").alias(p) for p in POLLUTANTS])
    else:
        daily = readings.groupBy("recorded_date").agg(*[F.avg(p).alias(p) for p in POLLUTANTS])
        d = join_small(days, daily, "recorded_date", "left", bound=DAYS_BOUND)
    return d.select("recorded_date", *POLLUTANTS, pm25_band("pm25", "Unknown").alias("pollution_category"))


def fact_from_staging(stg: DataFrame, pollution: DataFrame) -> DataFrame:
    """Staging -> ``fact_admissions``.  ``admission_id`` is the stable source
    row number (``sno``) instead of a database sequence."""
    s = stg.where(F.col("mrd_no").isNotNull() & F.col("doa").isNotNull())
    f = s.select(
        F.col("sno").cast("bigint").alias("admission_id"), left_chars("mrd_no", 20).alias("mrd_no"),
        "doa", "dod", "age", left_chars("age_bucket", 10).alias("age_bucket"),
        left_chars("gender", 10).alias("gender"),
        left_chars("type_of_admissionemergencyopd", 100).alias("department"),
        F.col("outcome").alias("diagnosis"), F.col("duration_of_stay").alias("length_of_stay"),
        F.weekofyear("doa").alias("admission_week"), is_death_outcome("outcome").alias("is_mortality_case"))
    pol = pollution.withColumnRenamed("recorded_date", "doa")
    j = join_small(f, pol, "doa", "left", bound=DAYS_BOUND)
    return j.select(*f.columns, *POLLUTANTS,
                    F.coalesce(F.col("pollution_category"), F.lit("Unknown")).alias("pollution_category"))


def fk_violations(fact: DataFrame, patients: DataFrame, departments: DataFrame) -> DataFrame:
    """Orphan foreign keys (NULL keys are allowed): (constraint_name, key_value, n_rows)."""
    def orphans(col: str, dim: DataFrame, name: str) -> DataFrame:
        o = fact.where(F.col(col).isNotNull()).join(dim.select(col), col, "left_anti")
        return o.groupBy(F.col(col).alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows")) \
                .select(F.lit(name).alias("constraint_name"), "key_value", "n_rows")
    return orphans("mrd_no", patients, "fk_patient").unionByName(orphans("department", departments, "fk_department"))


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str, order_cols) -> DataFrame:
    """ON CONFLICT (key) DO NOTHING: keep every target row, add the first
    incoming row (by ``order_cols``) of each key not yet present."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c != key]),
                                               F.struct(*order_cols)).alias("r")).select(key, "r.*")
    new = first.join(target.select(key), key, "left_anti")
    return target.unionByName(new.select(*target.columns))


# --- enrichment of raw admission / mortality / pollution files ------------------

def enrich_master(admissions: DataFrame, mortality: DataFrame, pollution: DataFrame) -> DataFrame:
    """Raw files -> master table: normalised names, safe dates, exact-duplicate
    removal, stay length, ISO week, age bucket, death flag, daily pollution.

    Deaths are reduced to one (earliest) date per patient before the join, so
    the join cannot multiply admissions; every admission of a patient with a
    death record is flagged, as in the reference.
    """
    # The date columns of the three files.
    dates = ["admission_date", "discharge_date", "death_date", "recorded_date"]
    a = coerce_dates(normalize_columns(admissions), dates).dropDuplicates()
    m = coerce_dates(normalize_columns(mortality), dates).dropDuplicates()
    p = coerce_dates(normalize_columns(pollution), dates).dropDuplicates()
    a = a.withColumns({
        "length_of_stay": F.date_diff("discharge_date", "admission_date"),
        "admission_week": F.weekofyear("admission_date"),
        "age_bucket": age_bucket("age")})
    deaths = m.where(F.col("patient_id").isNotNull()).groupBy("patient_id") \
              .agg(F.min("death_date").alias("death_date"))
    j = a.join(deaths, "patient_id", "left").withColumn("is_mortality_case", F.col("death_date").isNotNull())
    num = [c for c in P.numeric_columns(p) if c != "recorded_date"]
    daily = (p.where(F.col("recorded_date").isNotNull()).groupBy("recorded_date")
             .agg(*[F.avg(c).alias(c) for c in num]).withColumnRenamed("recorded_date", "admission_date"))
    return join_small(j, daily, "admission_date", "left", bound=DAYS_BOUND)


def raw_inputs(stg: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw-file-shaped inputs derived from the staging table: messy headers,
    dates as text, a slice of exact duplicate rows, and a death register."""
    adm = stg.select(
        F.col("sno").alias("S.No"), F.col("mrd_no").alias("Patient ID"),
        F.col("doa").cast("string").alias("Admission Date "),
        F.col("dod").cast("string").alias("Discharge Date"), F.col("age").alias("AGE"),
        F.col("gender").alias("GENDER "), F.col("type_of_admissionemergencyopd").alias("Admission Type"),
        F.col("outcome").alias("OUTCOME"))
    adm = adm.unionByName(adm.where(F.col("`S.No`") % 50 == 0))
    mort = stg.where(F.col("outcome") == "DEATH").select(
        F.col("mrd_no").alias("Patient ID"), F.col("dod").cast("string").alias("Death Date"))
    pol = readings.select(F.col("recorded_date").cast("string").alias("Recorded Date"),
                          F.col("pm25").alias("PM2.5"), F.col("pm10").alias("PM10"),
                          F.col("no2").alias("NO2"), F.col("so2").alias("SO2"))
    return adm, mort, pol


# --- profiling report ----------------------------------------------------------

def profile_overview(master: DataFrame, flag: str = "is_mortality_case") -> DataFrame:
    rate = F.avg(F.col(flag).cast("int")) * 100 if flag in master.columns else F.lit(None).cast("double")
    return master.agg(F.count(F.lit(1)).alias("num_rows"), rate.alias("mortality_rate_percent")) \
                 .withColumn("num_columns", F.lit(len(master.columns)))
