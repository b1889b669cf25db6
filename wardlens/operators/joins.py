"""Join with a per-group table.

``join_small`` broadcasts the small side only when its size is bounded by
construction (the caller names the bound, e.g. "one row per ISO week", at most
53 rows whatever the data size).  Otherwise the join is left to adaptive
execution, which broadcasts by measured bytes under
``spark.sql.autoBroadcastJoinThreshold`` and splits hot partitions of a
shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", bound: str | None = None) -> DataFrame:
    """Join ``big`` with a per-group table; ``bound`` says why ``small`` cannot grow with the data."""
    return big.join(F.broadcast(small) if bound else small, on, how)
