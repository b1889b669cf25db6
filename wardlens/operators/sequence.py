"""Per-entity sequence operators (previous row, visit number) that stay
correct and balanced when one entity holds a large share of all rows.

A plain ``Window.partitionBy(entity).orderBy(date)`` sends every row of an
entity to one task.  These operators split the work by (entity, date):

1. within one (entity, date) group rows are ordered by a unique tie key;
2. across dates, only one summary row per (entity, date) is windowed, so an
   entity contributes at most one row per calendar day to that window;
3. the two are joined back on (entity, date) — the same clustering as step 1,
   so the big side is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_within(df: DataFrame, entity: str, order_col: str, tie_col: str,
               value_col: str, out: str) -> DataFrame:
    """``out`` = ``value_col`` of the previous row of the same ``entity``,
    rows ordered by (``order_col``, ``tie_col``); NULL for the first row.

    Equivalent to ``lag(value_col) over (partition by entity order by
    order_col, tie_col)``.
    """
    w_in = Window.partitionBy(entity, order_col).orderBy(tie_col)
    rows = (df.withColumn("__prev_in", F.lag(value_col).over(w_in))
              .withColumn("__first", F.row_number().over(w_in) == 1))
    # One summary row per (entity, day): the value on its last row.
    days = (df.groupBy(entity, order_col)
              .agg(F.max_by(F.struct(F.col(value_col).alias("v")), F.col(tie_col)).alias("__last")))
    w_out = Window.partitionBy(entity).orderBy(order_col)
    days = days.select(entity, order_col, F.lag(F.col("__last.v")).over(w_out).alias("__prev_day"))
    j = rows.join(days, [entity, order_col], "left")
    return (j.withColumn(out, F.when(F.col("__first"), F.col("__prev_day")).otherwise(F.col("__prev_in")))
             .drop("__prev_in", "__first", "__prev_day"))


def dense_rank_within(df: DataFrame, entity: str, order_col: str, out: str) -> DataFrame:
    """``out`` = ``dense_rank() over (partition by entity order by order_col)``.

    Ranks are computed over the distinct (entity, order value) pairs only.
    NULL order values rank first, as Spark orders NULLs first ascending.
    """
    days = df.select(F.col(entity).alias("__e"), F.col(order_col).alias("__o")).distinct()
    w = Window.partitionBy("__e").orderBy(F.col("__o").asc_nulls_first())
    days = days.withColumn(out, F.row_number().over(w))
    cond = F.col(entity).eqNullSafe(F.col("__e")) & F.col(order_col).eqNullSafe(F.col("__o"))
    return df.join(days, cond, "left").drop("__e", "__o")
