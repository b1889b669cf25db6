"""Document fingerprints by winnowing.

The hashes of all runs of ``GRAM`` code points are taken, and of every
``WINDOW`` consecutive ones the smallest is kept, the rightmost of equals,
with its position.  Any match of ``GRAM + WINDOW - 1`` code points or more
between two texts therefore leaves a common entry in both fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.storage import stored
from wardlens.llm.text_hash import U64, gram_hashes

GRAM = 16
WINDOW = 64
STEP = 1 << 19
#: Ranges of doc_id per shuffle partition; their bounds, so many longs, are all that reaches the driver.
RANGES = 4

_ENTRY = np.dtype([("hash", ">u4"), ("place", ">u4")])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The entries ``(hash, place)`` of a text, in order of place; a text shorter than ``gram`` is one gram."""
    if not len(points):
        return np.zeros(0, _ENTRY)
    hashes = gram_hashes(points.astype(U64) + U64(1), min(gram, len(points)))
    last = U64((1 << 20) - 1)
    chosen = []
    windows = max(1, len(hashes) - window + 1)
    for i in range(0, windows, STEP):
        keys = hashes[i:min(i + STEP, windows) + window - 1]
        span = min(window, len(keys))
        keys = (keys & ~last) | (last - np.arange(len(keys), dtype=U64))
        reach = 1
        while 2 * reach <= span:
            keys = np.minimum(keys[:-reach], keys[reach:])
            reach *= 2
        if reach < span:
            keys = np.minimum(keys[:len(keys) - (span - reach)], keys[span - reach:])
        places = (last - (keys & last)).astype(np.int64)
        chosen.append(i + places[np.concatenate(([True], places[1:] != places[:-1]))])
    places = np.unique(np.concatenate(chosen)) if len(chosen) > 1 else chosen[0]
    out = np.empty(len(places), _ENTRY)
    out["hash"], out["place"] = hashes[places] >> U64(32), places
    return out


def as_string(entries: np.ndarray) -> str:
    """16 hex digits an entry: 8 of the hash, 8 of the place."""
    return entries.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of either fingerprint that both have; two empty ones are alike."""
    x, y = np.unique(a["hash"].astype(np.uint32)), np.unique(b["hash"].astype(np.uint32))
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row; a null or empty text has the empty fingerprint."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([as_string(winnow(code_points(t or ""))) for t in texts])
    return docs.select("doc_id", F.pandas_udf(run, "string")(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """The rows ``(doc_id, text, part, peek)`` dealt by ranges of doc_id and sorted, each range closed by the head of the next.

    The row after a row, in the same ``part``, is its successor by doc_id;
    rows with ``peek`` are only successors.  After the last row comes the first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right"))

    dealt = docs.withColumn("part", part(order))
    heads = [(r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.min(order).alias("head")).orderBy("part").collect()]
    if not heads:
        return dealt.withColumn("peek", F.lit(False))
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    peek = docs.where(order.isin(list(before))).withColumn(
        "part", F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), order))
    rows = dealt.withColumn("peek", F.lit(False)).unionByName(peek.withColumn("peek", F.lit(True)))
    return rows.repartition("part").sortWithinPartitions("part", "peek", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)`` its fingerprint, that of its edited text, and their likeness.

    The edited text ends with the beginning of the next row by doc_id in
    place of its last half.  A null text counts as empty; null doc_ids come
    first; rows of one doc_id follow each other by text.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for doc_id, text, part, peek in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "peek")), strict=True):
                if last and last[0] != part:
                    last = None
                if peek and not last:
                    continue
                own = winnow(code_points(text))
                if last:
                    _, before, left, first = last
                    changed = edited(left, text)
                    other = winnow(code_points(changed))
                    rows.append((before, len(left), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                 as_string(first), as_string(other), likeness(first, other), likeness(first, own)))
                last = None if peek else (part, doc_id, text, own)
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    return with_next(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def matches(docs: DataFrame) -> DataFrame:
    """``(a, b, hash, place_a, place_b)``: entries that two rows have in common, each row held against the first that has the hash."""
    prints = fingerprints(docs).where("doc_id is not null")
    entries = stored(prints.select("doc_id", F.explode(F.expr(
        "transform(filter(sequence(0, cast(length(fingerprint) / 16 as int)), i -> i * 16 < length(fingerprint)),"
        " i -> named_struct('hash', substr(fingerprint, i * 16 + 1, 8), 'place', cast(conv(substr(fingerprint, i * 16 + 9, 8), 16, 10) as long)))"))
        .alias("e")).select("doc_id", "e.*"), "entries")
    first = entries.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("f"))
    return entries.join(first, "hash").where("doc_id > f.doc_id").select(
        F.col("f.doc_id").alias("a"), F.col("doc_id").alias("b"), "hash", F.col("f.place").alias("place_a"), F.col("place").alias("place_b"))
