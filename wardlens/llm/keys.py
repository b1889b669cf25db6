"""A long that names a row of a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame) -> Column:
    """``doc_id`` where it is a key of the table; else a hash of doc_id and text, which only repeated rows share."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    seen = ids.groupBy("doc_id").count()
    if seen.where("doc_id is null or count > 1").isEmpty():
        return F.col("doc_id").cast("long")
    return F.xxhash64(F.col("doc_id"), F.col("text"))
