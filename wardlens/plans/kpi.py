"""Dashboard marts described by the reference (KPI slicers, winter
seasonality, pollution vs admissions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.columns import pct


def kpi_cube(fact: DataFrame) -> DataFrame:
    """KPI totals for every slicer combination of department, gender and age
    bucket (``cube``; ``grouping_id`` tells which slicers are 'all')."""
    death = F.col("is_mortality_case")
    n = F.count(F.lit(1))
    return fact.cube("department", "gender", "age_bucket").agg(
        F.grouping_id().alias("slicer_id"), n.alias("admissions"), F.count_if(death).alias("deaths"),
        F.round(F.avg("length_of_stay"), 2).alias("avg_los"), pct(F.count_if(death), n).alias("mortality_rate"))


def seasonal_index(fact: DataFrame) -> DataFrame:
    """Per calendar month: mean monthly admissions over the years and its
    ratio to the mean of all months (1.15 = 15% above an average month)."""
    monthly = fact.groupBy(F.year("doa").alias("y"), F.month("doa").alias("month_of_year")) \
                  .agg(F.count(F.lit(1)).alias("n"))
    overall = monthly.agg(F.avg("n")).scalar()
    return monthly.groupBy("month_of_year").agg(F.avg("n").alias("avg_admissions")) \
                  .withColumn("seasonal_index", F.col("avg_admissions") / overall)


def pollution_correlation(fact: DataFrame) -> DataFrame:
    """Pearson correlation of daily PM2.5 with daily admissions (days with a
    reading), one row."""
    daily = fact.groupBy("doa").agg(F.count(F.lit(1)).alias("admissions"), F.avg("pm25").alias("pm25")) \
                .where(F.col("pm25").isNotNull())
    return daily.agg(F.corr("pm25", F.col("admissions").cast("double")).alias("corr_pm25_admissions"),
                     F.count(F.lit(1)).alias("days"))
