"""Exact percentiles by selection, for any number of distinct values.

An exact percentile function holds every distinct value of a group in one
task.  Here values are counted per (key, value), the distinct values are
range-partitioned, prefix counts give each value the positions it takes, and
only the two values around each wanted position go on.  No task sees more than
a range of the values, and a value that a third of the rows share is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators.joins import join_small
from wardlens.operators.ranks import value_ranks
from wardlens.session import cut_lineage


def percentiles_of_counts(counts: DataFrame, keys: list[str], probs: dict[str, float], bound: str | None = None) -> DataFrame:
    """``counts(keys, value, cnt)``, values not null -> one row per key with a column for each probability.

    Linear interpolation between the two neighbouring values, as
    PERCENTILE_CONT has it.  ``bound`` says why there are few keys, if so; the
    wanted positions, a few for each key, are then broadcast.  Without keys
    the result is one row, of nulls for an empty table.
    """
    counts = cut_lineage(counts)
    ranked = value_ranks(counts, "value", keys=keys)
    before = F.col("rank") - (F.col("cnt") + 1) / 2.0
    ranked = ranked.select(*keys, "value", before.alias("first"), (before + F.col("cnt") - 1).alias("last"))
    sizes = counts.groupBy(*keys).agg(F.sum("cnt").alias("__n"))
    place = [F.struct(F.lit(name).alias("name"), ((F.col("__n") - 1) * F.lit(float(p))).alias("at")) for name, p in probs.items()]
    wanted = sizes.where("__n > 0").select(*keys, F.explode(F.array(*place)).alias("w")).select(*keys, "w.name", "w.at")
    if keys:
        near = join_small(ranked, wanted, keys, bound=bound)
    else:
        # A row for each probability: bounded.
        near = ranked.withColumn("__k", F.lit(1)).join(F.broadcast(wanted.withColumn("__k", F.lit(1))), "__k")
    low, high = F.floor("at"), F.ceil("at")
    near = near.where((F.col("last") >= low) & (F.col("first") <= high))
    part = F.col("at") - low
    # The values at the positions below and above: one value, or two neighbours.
    found = near.groupBy(*keys, "name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(part).alias("part"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in probs])


def percentiles(df: DataFrame, keys: list[str] | str, value: str, probs: dict[str, float], bound: str | None = None) -> DataFrame:
    """Exact percentiles of a column per key; null values count for nothing, and a key without values has no row."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return percentiles_of_counts(counts, keys, probs, bound)


def column_percentiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """``(column_name, <probs>)``: exact percentiles of many numeric columns at once; a column of nulls only has no row."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("value").isNotNull()) \
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return percentiles_of_counts(counts, ["column_name"], probs, bound="a row for each column and probability")
