"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its
minimum and its maximum, so a signature of ``2 * PERMUTATIONS`` values costs
``PERMUTATIONS`` evaluations a shingle.  Both agree between two sets with
probability equal to their Jaccard similarity.  Values are banded; documents
that share a band are candidates, and links are confirmed on the full sets.

Within a bucket no pairs are formed: first every member is held against one
pivot, the member that shares the most buckets.  Where that leaves a bucket
in more than one component, the pairs across components follow, without those
that cannot be linked by their sizes, by the triangle inequality of the
Jaccard distance to the pivot or by two bits of each signature value.  Copies
(equal sets) are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.components import components
from wardlens.llm.storage import discard, give_back, small_enough, stored
from wardlens.llm.text_hash import U64, mix, slices, string_buffers

SHINGLE = 5
PERCENT = 85
#: 504 signature values, in bands of as many rows as let a pair at the similarity threshold share no band with at most this probability:
#: 56 bands of 9 for 85 percent, 72 of 7 for 80.
PERMUTATIONS = 252
MISS = 4e-7
#: Pairs across components are compared on the full sets if no more of the values' lowest two bits differ than this many standard
#: deviations above the mean at the threshold; a linked pair fails that with probability 3e-7.
DEVIATIONS = 5.0
SEED = 20240229
#: Rows of 8 bytes; the ids of candidates go by broadcast up to storage.BROADCAST_BYTES.
ID_BYTES = 8

_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
_SETS = "doc_id long, shingles array<long>"


def _sets(col: pa.Array, size: int):
    """Yield (row, sorted distinct shingle hashes) for each row; fewer than ``size`` words make one shingle."""
    for part in slices(col, lower=True):
        hashes, rows = part.grams(size)
        cut = np.searchsorted(rows, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = hashes[cut[i]:cut[i + 1]]
            if not len(own):
                words = part.words[part.bounds[i]:part.bounds[i + 1]]
                if len(words):
                    k = U64(len(words))
                    own = mix(np.array([np.bitwise_xor.reduce(mix(words + np.arange(1, len(words) + 1, dtype=U64) * k))], U64))
            yield part.first + i, np.unique(own)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, n, U64) | U64(1), rng.integers(0, 1 << 64, n, U64)


def _signature(own: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then maxima: a band never holds both values of one permutation of a small set."""
    low = np.full(len(mult), np.iinfo(U64).max, U64)
    high = np.zeros(len(mult), U64)
    for i in range(0, len(own), 512):
        x = own[None, i:i + 512] * mult[:, None] + add[:, None]
        x ^= x >> U64(32)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate((low, high))


def band_rows(percent: int) -> int:
    """Rows of a band: the most that divide ``PERMUTATIONS`` and keep to ``MISS`` at the threshold."""
    able = [r for r in range(1, PERMUTATIONS + 1)
            if PERMUTATIONS % r == 0 and (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MISS]
    return max(able, default=1)


def _bands(signature: np.ndarray, n_rows: int) -> np.ndarray:
    rows = signature.reshape(-1, n_rows)
    place = np.arange(1, n_rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    which = np.arange(len(rows), dtype=U64)[:, None] * U64(0xC2B2AE3D27D4EB4F)
    return mix(np.bitwise_xor.reduce(mix(rows + place + which), axis=1)).view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of each value (mixed, as minima are small), 32 values to a long."""
    two = np.zeros(-(-len(signature) // 32) * 32, U64)
    two[:len(signature)] = mix(signature) & U64(3)
    return np.bitwise_or.reduce(two.reshape(-1, 32) << (U64(2) * np.arange(32, dtype=U64)), axis=1).view(np.int64)


def _alike(x: str, y: str, percent: int):
    """Whether few enough values differ in their two bits; three quarters of unequal values do."""
    values = 2 * PERMUTATIONS
    apart = 0.75 * (1 - percent / 100)
    most = int(values * apart + DEVIATIONS * (values * apart * (1 - apart)) ** 0.5)
    differ = F.lit(0)
    for i in range(-(-values // 32)):
        d = F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return differ <= most


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, bands, sketch)`` of each row; ``set_a, set_b`` are a 128-bit digest of the set."""
    n_rows = band_rows(percent)

    def run(batches):
        mult, add = _multipliers(PERMUTATIONS)
        for batch in batches:
            n, a, b, bands, sketches = [], [], [], [], []
            for _, own in _sets(batch.column("text"), SHINGLE):
                n.append(len(own))
                a.append(int(mix(own).sum().view(np.int64)) if len(own) else 0)
                b.append(int(mix(own ^ U64(0xA0761D6478BD642F)).sum().view(np.int64)) if len(own) else 0)
                signature = _signature(own, mult, add) if len(own) else None
                bands.append(None if signature is None else _bands(signature, n_rows))
                sketches.append(None if signature is None else _sketch(signature))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])
        give_back()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, _SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, shingles)``: the full set of each row as sorted hashes."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            held, at, size = [], [], 0
            for i, own in _sets(batch.column("text"), SHINGLE):
                held.append(own.view(np.int64))
                at.append(i)
                size += len(own)
                if size > 1 << 19:
                    yield _set_batch(ids, at, held)
                    held, at, size = [], [], 0
            if at:
                yield _set_batch(ids, at, held)
        give_back()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, _SETS)


def _set_batch(ids, at, held):
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(held, pa.list_(pa.int64()))],
                                      names=["doc_id", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``common, n_a, n_b`` from the full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_of_b"))

    def run(batches):
        for batch in batches:
            (oa, va), (ob, vb) = ((np.asarray(c.offsets), np.asarray(c.values)) for c in (batch.column("set_of_a"), batch.column("set_of_b")))
            common = [len(np.intersect1d(va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]], assume_unique=True)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(np.diff(oa), pa.int64()),
                 pa.array(np.diff(ob), pa.int64())], names=["a", "b", "common", "n_a", "n_b"])
        give_back()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_of_a", "set_of_b") \
        .mapInArrow(run, "a long, b long, common long, n_a long, n_b long")


def _linked(percent: int):
    return F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text, ...)``.

    A null, empty or white-space text has the empty set and is linked with
    nothing.  Repeated rows are returned each; different texts of one doc_id
    are one node for the links.  A null doc_id is returned with null
    component and ``kept`` true.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    signed = stored(signatures(docs, percent), "signatures")
    classes = stored(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")),
        "classes")
    rows = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = buckets = stored(rows.join(full, "bucket"), "buckets")

    weight = rows.groupBy("rep").agg(F.sum("members").alias("weight"))
    pivot = rows.join(weight, "rep").groupBy("bucket").agg(
        F.max(F.struct("weight", (-F.col("rep")).alias("low"), F.col("n_shingles").alias("size"))).alias("p")) \
        .select("bucket", (-F.col("p.low")).alias("pivot"), F.col("p.size").alias("pivot_size"))
    rows = rows.join(pivot, "bucket")
    near_size = F.least("n_shingles", "pivot_size") * 100 >= F.greatest("n_shingles", "pivot_size") * percent
    first = stored(rows.where(near_size & (F.col("rep") != F.col("pivot")))
                   .select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")

    ids = stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    wanted = F.broadcast(ids) if small_enough(ids, ID_BYTES) else ids
    sets = stored(shingle_sets(docs.select("doc_id", "text").where("doc_id is not null").join(wanted, "doc_id", "left_semi")),
                  "sets")
    if docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        of_rep = sets
    else:
        of_rep = sets.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "set_a"), "doc_id") \
            .where(F.size("shingles") == F.col("n_shingles")).dropDuplicates(["doc_id"]).select("doc_id", "shingles")
    held = stored(_confirmed(first, of_rep), "confirmed")
    links = held.where(_linked(percent)).select("a", "b")

    # Rows whose bucket still spans components: held against each other, save what is settled already.
    found = components(links)
    labelled = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("bucket")
    to_pivot = held.select(F.col("a").alias("pivot"), F.col("b").alias("rep"),
                           (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("away"))
    rest = stored(labelled.join(mixed, "bucket", "left_semi").join(to_pivot, ["pivot", "rep"], "left").select(
        "bucket", "rep", "n_shingles", "component", F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(F.col("away")).alias("away"),
        (F.col("rep") == F.col("pivot")).alias("is_pivot")), "mixed")
    able = stored(rest.where("not is_pivot").join(classes.select("rep", "bands", "sketch"), "rep"), "able")
    x, y = able.alias("x"), able.alias("y")
    reach = 1 - percent / 100 + 1e-9
    # A pair comes up once, in the least of the buckets that it shares.
    across = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep"))
                    & (F.col("x.component") != F.col("y.component"))
                    & (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * percent)
                    & (F.coalesce(F.abs(F.col("x.away") - F.col("y.away")), F.lit(0.0)) <= reach)
                    & _alike("x", "y", percent)
                    & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket"))) \
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = stored(_confirmed(across, of_rep).where(_linked(percent)).select("a", "b"), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    for done in (buckets, first, ids, sets, held, rest, able, more):  # the components are stored; what led to them is read no more
        discard(done)

    member = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(
        classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"], "left")
    out = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
