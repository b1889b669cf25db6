"""Average ranks (ties share the mean of their positions) without a global
sort window over raw rows.

1. collapse to (value, count) — map-side combined, so heavy ties cost nothing;
2. range-partition the distinct values, checkpoint (fixes the partition
   assignment and cuts lineage in the shared checkpoint folder);
3. per-partition totals (<= #partitions rows) -> prefix offsets (a window
   over that tiny table), broadcast back;
4. within each partition a running sum over its own slice of values.

rank(value) = rows_before + (count + 1) / 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import cut_lineage


def value_ranks(counts: DataFrame, value: str, count_col: str = "cnt", keys=(),
                partitions: int | None = None) -> DataFrame:
    """(keys, value, cnt) -> (keys, value, cnt, rank): average ranks of the
    values within each key group (over all rows: ``cnt`` rows per value)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    r = counts.repartitionByRange(n, *[F.col(k) for k in keys], F.col(value)) \
              .withColumn("__pid", F.spark_partition_id())
    r = cut_lineage(r)
    tot = r.groupBy("__pid", *keys).agg(F.sum(count_col).alias("__ptot"))
    wo = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1) if keys \
        else Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("__off", F.coalesce(F.sum("__ptot").over(wo), F.lit(0)))
    # <= partitions x key groups present in each range slice: bounded broadcast.
    r = r.join(F.broadcast(off.select("__pid", *keys, "__off")), ["__pid", *keys])
    w = Window.partitionBy("__pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__off") + F.coalesce(F.sum(count_col).over(w), F.lit(0))
    return r.select(*keys, value, count_col, (before + (F.col(count_col) + 1) / 2.0).alias("rank"))


def tie_term(counts: DataFrame, count_col: str = "cnt") -> DataFrame:
    """One row: sum over tie groups of (t^3 - t)."""
    t = F.col(count_col).cast("double")
    return counts.agg(F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"))
