"""Deterministic sampling and splitting by hashes (repeatable under any
repartitioning, unlike row-position based sampling).

``sample_per_group``: the ``k`` rows with the smallest ``xxhash64(id, seed)``
per group, taken first within hash shards of the group, so that no task sees
more than a shard of a large group or ``k`` rows of each shard.

``hash_split`` / ``stratified_split``: fixed-seed train/test splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.operators.joins import join_small

_TWO64 = 18446744073709551616.0
#: A shuffle by a label would send each class, most of the table maybe, to one task.
CLASSES_BOUND = "one row per class of the label"


def _unit_hash(cols, seed: int):
    """xxhash64 of the columns mapped to [0, 1)."""
    h = F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)).cast("double")
    return (h + 9223372036854775808.0) / _TWO64


def sample_per_group(df: DataFrame, groups, id_cols, k: int, seed: int = 42, shards: int = 64) -> DataFrame:
    """Exactly min(k, group size) rows per group: those with the smallest hash."""
    groups = [groups] if isinstance(groups, str) else list(groups)
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    d = df.withColumn("__u", _unit_hash(id_cols, seed)).withColumn("__shard", F.pmod(F.xxhash64(*id_cols), F.lit(shards)))
    for keys in ([*groups, "__shard"], groups):
        w = Window.partitionBy(*keys).orderBy("__u", *id_cols)
        d = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return d.drop("__u", "__shard", "__rn")


def hash_split(df: DataFrame, id_cols, test_fraction: float = 0.2, seed: int = 42,
               col: str = "is_test") -> DataFrame:
    """Bernoulli split by hash: repeatable, no shuffle."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return df.withColumn(col, _unit_hash(id_cols, seed) < test_fraction)


def stratified_split(df: DataFrame, label: str, id_cols, test_fraction: float = 0.2, seed: int = 42,
                     col: str = "is_test") -> DataFrame:
    """Exact per-label split: within each label the ceil(f * n_label) rows
    with the smallest hash form the test set, so every stratum keeps its
    proportion to within one row.  The hash ranks come from the
    range-partitioned rank operator over all rows, balanced even when one
    label holds most of them."""
    from wardlens.operators.ranks import value_ranks
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    d = df.withColumn("__u", _unit_hash(id_cols, seed))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    ranks = value_ranks(d.groupBy(label, "__u").agg(F.count(F.lit(1)).alias("cnt")), "__u", keys=[label])
    cut = join_small(ranks, sizes, label, bound=CLASSES_BOUND).where(F.col("rank") <= F.ceil(F.lit(test_fraction) * F.col("__n")))
    thr = cut.groupBy(label).agg(F.max("__u").alias("__thr"))
    out = join_small(d, thr, label, "left", bound=CLASSES_BOUND)
    return out.withColumn(col, F.coalesce(F.col("__u") <= F.col("__thr"), F.lit(False))).drop("__u", "__thr")
