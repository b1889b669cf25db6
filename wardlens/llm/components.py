"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a grouped minimum and one join, so nothing but row counts and
one checksum reaches the driver.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.storage import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a")
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                        F.col("m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` with the smallest reachable node for each node that is not its own.

    A node without links, or that is the smallest of its component, has no
    row.  Loops, repeated and reversed links change nothing; an empty table
    gives an empty table; rows with a null end are ignored.
    """
    now = stored(links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        after = stored(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
