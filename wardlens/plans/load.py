"""The warehouse as catalog tables: create, load, reset, refresh.

A build may break anywhere and be run again.  Tables are created if they are
absent, dimensions take only keys that they lack (the first row of a key
wins), and the fact takes only admissions that it lacks, so a second run adds
what the first one did not and otherwise nothing.  An insert is visible as a
whole or not at all.  Tables are dropped in the reverse order of dependence.

Summaries are kept as partial sums, one partition for each batch: a refresh
writes the sums of its own batch only, a repeated batch replaces its partition,
and the summary adds up the partitions, in whatever order they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.columns import left_chars, month_start, pct
from wardlens.operators import profile as P
from wardlens.plans.warehouse import dim_department, dim_patient, dim_pollution, fact_from_staging

#: The tables in order of dependence, with their columns.
TABLES = {
    "dim_patient": "mrd_no STRING, age INT, gender STRING",
    "dim_department": "department STRING, specialty STRING",
    "dim_pollution": "recorded_date DATE, pm25 DOUBLE, pm10 DOUBLE, no2 DOUBLE, so2 DOUBLE, pollution_category STRING",
    "fact_admissions": "admission_id BIGINT, mrd_no STRING, doa DATE, dod DATE, age INT, age_bucket STRING, gender STRING, department STRING, "
                       "diagnosis STRING, length_of_stay INT, admission_week INT, is_mortality_case BOOLEAN, pm25 DOUBLE, pm10 DOUBLE, no2 DOUBLE, "
                       "so2 DOUBLE, pollution_category STRING",
}
KEYS = {"dim_patient": "mrd_no", "dim_department": "department", "dim_pollution": "recorded_date", "fact_admissions": "admission_id"}


def create(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database and whichever of its tables are absent; those that exist stay as they are."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def reset(spark: SparkSession, database: str) -> None:
    """Drop the tables, those that refer to others first."""
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def _insert_missing(rows: DataFrame, database: str, name: str) -> None:
    """Insert the rows whose key the table lacks; a null key is no key and goes in nowhere."""
    spark, key = rows.sparkSession, KEYS[name]
    target = spark.table(f"{database}.{name}")
    new = rows.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")
    new.select(*target.columns).write.insertInto(f"{database}.{name}")


def load(staging: DataFrame, database: str, readings: DataFrame | None = None) -> None:
    """Load a batch of the staging table: the dimensions, then the fact with what the pollution dimension holds by then."""
    spark = staging.sparkSession
    _insert_missing(dim_patient(staging), database, "dim_patient")
    _insert_missing(dim_department(staging), database, "dim_department")
    _insert_missing(dim_pollution(staging, readings), database, "dim_pollution")
    fact = fact_from_staging(staging, spark.table(f"{database}.dim_pollution"))
    first = fact.groupBy("admission_id").agg(F.min(F.struct(*[c for c in fact.columns if c != "admission_id"])).alias("r")).select("admission_id", "r.*")
    _insert_missing(first, database, "fact_admissions")


def row_counts(spark: SparkSession, database: str) -> DataFrame:
    """``(table_name, n_rows)`` of each table."""
    out = None
    for name in TABLES:
        one = spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


# --- schema registry ---------------------------------------------------------------------------

def schema_table(df: DataFrame) -> DataFrame:
    """``(position, column_name, data_type)`` of a frame's columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def schema_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(column_name, expected_type, actual_type, status)``: every column of either frame.

    ``status`` is ``ok``, ``missing``, ``unexpected`` or ``type``; names are compared without case.
    """
    e = schema_table(expected).select(F.lower("column_name").alias("column_name"), F.col("data_type").alias("expected_type"))
    a = schema_table(actual).select(F.lower("column_name").alias("column_name"), F.col("data_type").alias("actual_type"))
    status = F.when(F.col("actual_type").isNull(), "missing").when(F.col("expected_type").isNull(), "unexpected") \
        .when(F.col("expected_type") != F.col("actual_type"), "type").otherwise("ok")
    return e.join(a, "column_name", "full").withColumn("status", status)


def declared(spark: SparkSession, name: str) -> DataFrame:
    """An empty frame with the declared columns of a table."""
    return spark.createDataFrame([], TABLES[name])


# --- ingest with rejects -----------------------------------------------------------------------

CORRUPT = "corrupt_record"


def checked(raw: DataFrame, types: dict[str, str], required: list[str]) -> DataFrame:
    """Text rows with a column for each typed value and ``reasons``, why the row cannot be taken.

    A row is out if its line does not fit the header, if a value that is there
    cannot be read as its type, or if a required one is missing.  Blank text
    counts as missing, except in text columns, which keep it.
    """
    text = {c: F.trim(F.col(c)) for c in types}
    typed = {c: F.col(c) if t == "string" else F.nullif(text[c], F.lit("")).try_cast(t) for c, t in types.items()}
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("line"))] if CORRUPT in raw.columns else []
    reasons += [F.when((text[c] != "") & typed[c].isNull(), F.lit(f"{t}: {c}")) for c, t in types.items() if t != "string"]
    reasons += [F.when(F.coalesce(text[c], F.lit("")) == "", F.lit(f"missing: {c}")) for c in required]
    return raw.select(*[x.alias(f"typed_{c}") for c, x in typed.items()], *[F.col(c) for c in types],
                      F.filter(F.array(*reasons), lambda x: x.isNotNull()).alias("reasons"))


def accepted(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """The typed rows without a reason against them."""
    return rows.where(F.size("reasons") == 0).select(*[F.col(f"typed_{c}").alias(c) for c in types])


def rejected(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """The rows set aside, as text, with the reasons."""
    return rows.where(F.size("reasons") > 0).select(*types, F.array_join("reasons", "; ").alias("reasons"))


# --- summaries that are refreshed ------------------------------------------------------------------

def batch_sums(fact: DataFrame, keys: list, batch: str) -> DataFrame:
    """Partial sums of a batch: admissions, stays, their sum, deaths."""
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("admissions"), F.count("length_of_stay").alias("stays"), F.sum(F.col("length_of_stay").cast("bigint")).alias("stay_sum"),
        F.count_if("is_mortality_case").alias("deaths")).withColumn("batch", F.lit(batch))


def refresh(fact: DataFrame, keys: list, batch: str, path: str) -> None:
    """Write the sums of one batch in the place of what that batch had before."""
    batch_sums(fact, keys, batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _totals(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("admissions", "stays", "stay_sum", "deaths")])


def _mean():
    return F.round(F.col("stay_sum") / F.nullif(F.col("stays"), F.lit(0)), 2)


def department_summary(spark: SparkSession, path: str) -> DataFrame:
    """The department mart from its partial sums."""
    t = _totals(spark, path, "department")
    return t.select("department", F.col("admissions").alias("total_admissions"), _mean().alias("avg_los"), "deaths",
                    pct(F.col("deaths"), F.col("admissions")).alias("mortality_rate"))


def monthly_summary(spark: SparkSession, path: str) -> DataFrame:
    """The monthly summary from its partial sums."""
    t = _totals(spark, path, "summary_month")
    return t.select("summary_month", F.col("admissions").cast("int").alias("total_admissions"), _mean().alias("avg_los"),
                    pct(F.col("deaths"), F.col("admissions")).alias("mortality_rate"))


def month_key():
    return month_start("doa").alias("summary_month")


# --- SQL surface ---------------------------------------------------------------------------------

def register_views(fact: DataFrame) -> None:
    """The views over the fact and the table function ``department_efficiency(dept)``, for ``spark.sql``."""
    spark = fact.sparkSession
    fact.createOrReplaceTempView("fact_admissions")
    views = {
        "vw_high_risk_admissions": "SELECT * FROM fact_admissions WHERE length_of_stay > 15 OR is_mortality_case = TRUE",
        "vw_weekly_mortality_ma": """
            SELECT admission_week, total_admissions, deaths,
              ROUND(AVG(deaths) OVER (ORDER BY admission_week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS death_ma
            FROM (SELECT admission_week, COUNT(*) AS total_admissions, COUNT_IF(is_mortality_case) AS deaths FROM fact_admissions GROUP BY admission_week)""",
    }
    for name, body in views.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {body}")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION department_efficiency(dept STRING)
        RETURNS TABLE (department STRING, avg_los DOUBLE, mortality_rate DOUBLE, efficiency_score DOUBLE)
        RETURN SELECT f.department, ROUND(AVG(f.length_of_stay), 2), ROUND(100.0D * COUNT_IF(f.is_mortality_case) / COUNT(*), 2),
            ROUND(100.0D * SUM(CASE WHEN NOT f.is_mortality_case THEN 1 ELSE 0 END) * COUNT(f.length_of_stay) / NULLIF(SUM(f.length_of_stay), 0), 2)
          FROM fact_admissions f WHERE f.department = dept GROUP BY f.department""")


# --- smaller pieces --------------------------------------------------------------------------------

def without_copies(df: DataFrame, ignore: str) -> DataFrame:
    """One row of each group of rows that agree in all columns but ``ignore``: that of the smallest ``ignore``."""
    rest = [c for c in df.columns if c != ignore]
    return df.groupBy(*rest).agg(F.min(ignore).alias(ignore)).select(*df.columns)


def type_report(df: DataFrame) -> DataFrame:
    """``(data_type, n_columns, n_numeric)``: the columns of a frame by type."""
    numeric = set(P.numeric_columns(df))
    rows = [(t, int(c in numeric)) for c, t in df.dtypes]
    d = df.sparkSession.createDataFrame(rows, "data_type string, is_numeric int")
    return d.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("is_numeric").alias("n_numeric"))


def male_flag(gender: str = "gender"):
    """1 for M, 0 for any other gender, missing ones too."""
    return F.when(left_chars(gender, 10) == "M", 1).otherwise(0)
