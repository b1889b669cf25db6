"""Exact and approximate group percentiles.

``percentile`` (exact, linear interpolation == PERCENTILE_CONT) keeps a
value->count map per group in its partial aggregate, so memory is bounded by
the number of distinct values (small for day counts).  For continuous
high-cardinality measures pass ``approx=True`` (``percentile_approx``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_percentiles(df: DataFrame, keys, value: str, probs: dict[str, float],
                      approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """One row per group with one column per named probability."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ps = list(probs.values())
    if approx:
        arr = F.percentile_approx(F.col(value).cast("double"), ps, accuracy)
    else:
        arr = F.percentile(F.col(value), ps)
    g = df.groupBy(*keys).agg(arr.alias("__p"))
    return g.select(*keys, *[F.col("__p")[i].alias(name) for i, name in enumerate(probs)])
