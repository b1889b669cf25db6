"""Column profiling as distributed aggregates.

All per-column statistics are computed in one pass where possible and
returned in long form (one row per column), using ``stack``/``unpivot``
rather than a driver-side loop over results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators.order_stats import column_percentiles

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def _long(row_df: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """Turn one wide row of struct columns into one row per column name."""
    arr = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("s")) for n in names])
    e = row_df.select(F.explode(arr).alias("x"))
    return e.select(F.col("x.column_name").alias("column_name"), *[F.col(f"x.s.{f}").alias(f) for f in fields])


def null_summary(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_percent) for every column, one pass."""
    n = F.count(F.lit(1))
    aggs = [F.struct(F.count_if(F.col(c).isNull()).alias("null_count"),
                     (F.lit(100.0) * F.count_if(F.col(c).isNull()) / n).alias("null_percent")).alias(c)
            for c in df.columns]
    return _long(df.agg(*aggs), df.columns, ["null_count", "null_percent"])


def numeric_describe(df: DataFrame, cols=None) -> DataFrame:
    """count, mean, std (n-1), min, exact p25/p50/p75, max per numeric column.

    The percentiles come by selection over the distinct values of all columns,
    so a unique column of any length fits."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    wide = _long(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    quartiles = column_percentiles(df, cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    # A row for each column: bounded.
    return wide.join(F.broadcast(quartiles), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _cells(df: DataFrame, cols) -> DataFrame:
    """(column_name, value) for every non-NULL cell of ``cols`` (as text)."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in cols])
    e = df.select(F.explode(arr).alias("x")).select("x.column_name", "x.value")
    return e.where(F.col("value").isNotNull())


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column_name, value, count) — NULL values dropped, as value_counts does."""
    return _cells(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def categorical_describe(df: DataFrame, cols=None) -> DataFrame:
    """count, unique, top, freq per text column; ties for top go to the
    smallest value.  Aggregates only — no per-column window."""
    cols = cols or string_columns(df)
    vc = value_counts(df, cols)
    return vc.groupBy("column_name").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("top"),
        F.max("count").alias("freq"))


def unique_counts(df: DataFrame, cols=None) -> DataFrame:
    """Exact distinct non-NULL count per column (``nunique``)."""
    cols = cols or df.columns
    return value_counts(df, cols).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Number of rows that repeat an earlier row (n - distinct n), one row."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
