"""Removal of passages that repeat anywhere in the corpus, by level-wise doubling.

A window of ``LENGTH`` words can repeat only if its parts do, so a level is
searched only where the level of half its length found repeats.  The first
level looks at runs of ``(LENGTH - 1) / 2`` words, and only at the smallest of
those in each window: equal windows have the same smallest run at the same
place, so a window whose smallest run is alone is itself alone.  That leaves a
tenth of the runs to be counted, and of the windows those around a run that
repeats.  ``longest_repeats`` goes on doubling until no candidate survives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.bitmap import Bitmap, bitmap
from wardlens.llm.keys import row_key
from wardlens.llm.storage import discard, stored
from wardlens.llm.text_hash import U64, gram_hashes, slices

LENGTH = 35
#: Words in one step of the search for smallest runs; places within it take 20 bits.
STEP = 1 << 19


def window_anchors(words: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words the start of its smallest run of ``(length - 1) // 2`` words, the last of equals."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    run = max(1, (length - 1) // 2)
    span = length - run + 1
    if n > STEP:
        return np.concatenate([i + window_anchors(words[i:i + STEP + length - 1], length) for i in range(0, n, STEP)])
    last = U64((1 << 20) - 1)
    keys = gram_hashes(words, run)
    keys = (keys & ~last) | (last - np.arange(len(keys), dtype=U64))
    reach = 1
    while 2 * reach <= span:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if reach < span:
        keys = np.minimum(keys[:len(keys) - (span - reach)], keys[span - reach:])
    return (last - (keys & last)).astype(np.int64)


def _longs(*columns):
    return [pa.array(np.concatenate(c).astype(np.uint64).view(np.int64) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """``(run, key, place)`` of the smallest runs of all windows."""
    size = max(1, (length - 1) // 2)

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for part in slices(batch.column("text"), lower=False):
                out, own, at = [], [], []
                for i in range(len(part)):
                    words = part.words[part.bounds[i]:part.bounds[i + 1]]
                    if len(words) < length:
                        continue
                    places = np.unique(window_anchors(words, length))
                    out.append(gram_hashes(words, size)[places])
                    own.append(np.full(len(places), keys[part.first + i]).view(U64))
                    at.append(places)
                if out:
                    yield pa.RecordBatch.from_arrays(_longs(out, own, at), names=["run", "key", "place"])
    return docs.select("key", "text").mapInArrow(run, "run long, key long, place long")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """``(window, key, place)`` of the windows whose smallest run is listed in ``places``."""
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            lists = batch.column("places")
            ends, listed = np.asarray(lists.offsets), np.asarray(lists.values)
            for part in slices(batch.column("text"), lower=False):
                out, own, at = [], [], []
                for i in range(len(part)):
                    row = part.first + i
                    words = part.words[part.bounds[i]:part.bounds[i + 1]]
                    known = np.zeros(len(words), bool)
                    known[listed[ends[row]:ends[row + 1]]] = True
                    starts = np.flatnonzero(known[window_anchors(words, length)])
                    out.append(gram_hashes(words, length)[starts])
                    own.append(np.full(len(starts), keys[row]).view(U64))
                    at.append(starts)
                if out:
                    yield pa.RecordBatch.from_arrays(_longs(out, own, at), names=["window", "key", "place"])
    return docs.select("key", "text", "places").mapInArrow(run, "window long, key long, place long")


def _repeated(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose ``by`` occurs more than once.

    Counts are pre-aggregated; rows that a bitmap of the repeated values
    rules out are not shuffled; the join may split a hot value.
    """
    twice = stored(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(by), "repeated")
    known = bitmap(twice, by)
    sent = rows.sparkSession.sparkContext.broadcast((known.bits, known.words))

    def run(batches):
        filled = Bitmap(*sent.value)
        for batch in batches:
            yield batch.take(pa.array(filled.may_have(batch.column(by).to_numpy().view(U64))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds).join(twice, by)


def _alone(rows: DataFrame, by: str) -> DataFrame:
    """``(key, alone)``: the places of each row whose ``by`` occurs nowhere else, by one aggregation and no join."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at")).where("n = 1") \
        .groupBy("at.key").agg(F.collect_list(F.col("at.place").cast("int")).alias("alone"))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """``docs(key, text)`` with ``places``, the starts of the smallest runs that repeat; rows without any have no row."""
    runs = stored(_anchors(docs, length), "anchors")
    lists = stored(_repeated(runs, "run").groupBy("key").agg(F.collect_set(F.col("place").cast("int")).alias("places")), "places")
    discard(runs)
    return lists


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(window, key, place)`` of every window of ``length`` words that starts somewhere else too; a stored table.

    ``docs(key, text)``; ``key`` names a row, as ``keys.row_key`` does.
    """
    docs = docs.select("key", "text")
    around = stored(_windows(docs.join(_anchored(docs, length), "key"), length), "windows")
    found = stored(_repeated(around, "window").select("window", "key", "place"), "found")
    discard(around)
    return found


def longest_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(key, place, length)``: for each repeated window the greatest ``length * 2^i`` at which it still repeats.

    A window of twice the length is a candidate only where both halves
    repeat; levels follow until none survives.
    """
    level = repeated_windows(docs, length)
    out = level.select("key", "place", F.lit(length).alias("length")).distinct()
    while not level.isEmpty():
        ahead = level.select("key", (F.col("place") - length).alias("place"), F.col("window").alias("ahead"))
        wider = stored(level.join(ahead.distinct(), ["key", "place"]).select(
            F.xxhash64("window", "ahead").alias("window"), "key", "place"), "wider")
        length *= 2
        level = stored(_repeated(wider, "window").select("window", "key", "place"), "found")
        out = out.union(level.select("key", "place", F.lit(length).alias("length")).distinct())
    return out.groupBy("key", "place").agg(F.max("length").alias("length"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for each row of ``docs(doc_id, text, ...)``.

    Each word under a repeated window is removed; the kept words are joined
    by one space.  A null or empty text has no words and an empty
    ``kept_text``.  Repeated rows are separate documents that repeat each
    other.  Other columns are ignored.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", row_key(docs).alias("key"))
    lists = _anchored(docs, length)
    around = _windows(docs.join(lists, "key"), length)
    alone = stored(_alone(around, "window"), "alone")
    rows = docs.join(lists, "key", "left").join(alone, "key", "left")

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            lists = batch.column("places"), batch.column("alone")
            for part in slices(batch.column("text"), lower=False):
                for i in range(len(part)):
                    places, singles = (x[part.first + i] for x in lists)
                    a, b = part.bounds[i], part.bounds[i + 1]
                    stay = np.arange(a, b)
                    if places.is_valid:
                        known = np.zeros(b - a, bool)
                        known[places.values.to_numpy()] = True
                        repeats = known[window_anchors(part.words[a:b], length)]
                        if singles.is_valid:
                            repeats[singles.values.to_numpy()] = False
                        edge = np.zeros(b - a + 1, np.int64)
                        at = np.flatnonzero(repeats)
                        edge[at] += 1
                        edge[at + length] -= 1
                        stay = a + np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    raw = part.raw
                    kept.append(b" ".join([raw[s:e].tobytes() for s, e in zip(part.starts[stay].tolist(), part.ends[stay].tolist(), strict=True)])
                                if len(stay) < b - a else b" ".join(raw[part.offsets[i]:part.offsets[i + 1]].tobytes().split()))
                    n.append(int(b - a))
                    gone.append(int(b - a) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])
    return rows.select("doc_id", "text", "places", "alone").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_text string")
