"""Benchmark decontamination by spaced-seed hashing.

A mask says which words of a run count; the others may differ.  The words
under each mask, at every place of every benchmark item and of every document,
are hashed.  Documents are searched through a bitmap of the items' hashes,
whose size is fixed; what passes is joined to the table of the items' hashes.
Each hit fixes how item and document lie against each other, and the overlap
around it is verified word by word, substitutions being allowed.

The masks are all that have five words that count and at most two free ones
between.  Every overlap that ``best_overlap`` accepts fits one of them: its
shortest head with 13 equal words holds at most 6 substitutions, which part
these words into at most 7 runs.  Were no three runs in a row to hold 5 of
them, runs 1 to 3 and 4 to 6 held 8 at most, so the last 5 by itself.  A
shorter item has at most 3 substitutions beside its 0.8, and its runs hold 5
in the same way from six words on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.bitmap import Bitmap, bitmap
from wardlens.llm.keys import row_key
from wardlens.llm.storage import give_back, stored
from wardlens.llm.text_hash import U64, mix, slices


def _spaced(weight: int, longest: int) -> list[str]:
    """All masks that begin and end with a word that counts, have ``weight`` of them and are no longer than ``longest``."""
    return ["1" + "".join("0" if i in free else "1" for i in range(n - 2)) + "1"
            for n in range(weight, longest + 1) for free in combinations(range(n - 2), n - weight)]


#: Masks for items of six words and more, then those for items of five: 1 is a word that counts.
MASKS = tuple(_spaced(5, 7))
MASKS_OF_FIVE = tuple(_spaced(4, 5))
#: Items of fewer words than this are not searched: a word or two are found anywhere.
LEAST_WORDS = 5
#: A document is contaminated by an overlap of so many equal words, or of this share of a shorter item.
OVERLAP = 13
SHARE = 0.8
#: What a substituted word costs an overlap, in equal words.
SUBSTITUTION = 2
#: Words of a document that are kept around hits.
AROUND = 64
#: Items of fewer words have masks of their own.
_SHORT = 6


def _masks(n_words: int) -> list[tuple[int, str]]:
    """The masks to search an item by, numbered."""
    if n_words >= _SHORT:
        return list(enumerate(MASKS))
    return list(enumerate(MASKS_OF_FIVE, 100)) if n_words >= LEAST_WORDS else []


def seed_hashes(words: np.ndarray, masks: list[tuple[int, str]]) -> Iterator[tuple[str, np.ndarray]]:
    """Each mask with the hash of the words under it at every place where it fits."""
    terms = [words * U64((2 * at + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1) for at in range(max((len(m) for _, m in masks), default=0))]
    for number, mask in masks:
        n = max(0, len(words) - len(mask) + 1)
        total = np.full(n, number * 0xD1342543DE82EF95 % (1 << 64), U64)
        for at, c in enumerate(mask):
            if c == "1":
                total += terms[at][at:at + n]
        yield mask, mix(total)


def _words(items: DataFrame) -> DataFrame:
    """``(item_id, words)`` of each distinct item: equal texts are one item, that of the smallest id."""
    def run(batches):
        for batch in batches:
            out = [p.words[p.bounds[i]:p.bounds[i + 1]].view(np.int64) for p in slices(batch.column("text"), lower=True) for i in range(len(p))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "words"])
    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "item_id long, words array<long>")
    return found.where(F.size("words") >= LEAST_WORDS).groupBy("words").agg(F.min("item_id").alias("item_id"))


def _seeds(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for item, own in zip(batch.column("item_id").to_pylist(), batch.column("words"), strict=True):
                own = own.values.to_numpy().view(U64)
                for _, hashes in seed_hashes(own, _masks(len(own))):
                    rows += [(int(h), item, at) for at, h in enumerate(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["seed", "item_id", "item_place"])
    return words.mapInArrow(run, "seed long, item_id long, item_place long")


def _regions(docs: DataFrame, found: Bitmap, masks: list[tuple[int, str]]) -> DataFrame:
    """Stretches of documents around seeds that the bitmap lets through: ``(key, doc_id, start, words, seeds, places)``."""
    sent = docs.sparkSession.sparkContext.broadcast((found.bits, found.words))
    names = ["key", "doc_id", "start", "words", "seeds", "places"]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3

    def run(batches):
        known = Bitmap(*sent.value)
        for batch in batches:
            for part in slices(batch.column("text"), lower=True):
                doc = np.repeat(np.arange(len(part)), np.diff(part.bounds))
                at, what = [], []
                for mask, seeds in seed_hashes(part.words, masks):
                    first = known.may_have(seeds)
                    first = first[doc[first] == doc[first + len(mask) - 1]]
                    at.append(first)
                    what.append(seeds[first])
                at, what = np.concatenate(at), np.concatenate(what).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, what = at[order], what[order]
                apart = np.flatnonzero((np.diff(at) > AROUND) | (np.diff(doc[at]) != 0)) + 1
                edges, rows = [0, *apart.tolist(), len(at)] if len(at) else [], []
                for i, j in zip(edges, edges[1:], strict=False):
                    row = doc[at[i]]
                    head, tail = part.bounds[row], part.bounds[row + 1]
                    a, b = max(head, at[i] - AROUND), min(tail, at[j - 1] + AROUND)
                    rows.append((part.first + row, a - head, part.words[a:b].view(np.int64), what[i:j], at[i:j] - head))
                if rows:
                    of = pa.array([r[0] for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(of), batch.column("doc_id").take(of),
                         *(pa.array([r[k] for r in rows], t) for k, t in zip((1, 2, 3, 4), kinds[2:], strict=True))], names=names)
        give_back()
    return docs.select("key", "doc_id", "text").mapInArrow(
        run, "key long, doc_id long, start long, words array<long>, seeds array<long>, places array<long>")


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(first, end, equal words) of the stretch with the most equal words, each substitution costing ``SUBSTITUTION`` of them."""
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 1, -SUBSTITUTION))))
    least = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - least))
    first = int(np.argmin(gain[:end + 1])) if end else 0
    return first, end, int(equal[first:end].sum())


def _verified(near: DataFrame) -> DataFrame:
    """``near(key, doc_id, item_id, place, item_words, words, own)``, equally long stretches of document and item -> the overlaps that are large enough."""
    names = ["key", "doc_id", "item_id", "place", "span", "n_equal", "item_words"]

    def run(batches):
        for batch in batches:
            size = batch.column("item_words").to_numpy()
            least = np.minimum(OVERLAP, np.ceil(SHARE * size)).astype(np.int64)
            (off, words), (other, own) = ((np.asarray(c.offsets), np.asarray(c.values)) for c in (batch.column("words"), batch.column("own")))
            equal = words[off[0]:off[-1]] == own[other[0]:other[-1]]
            off = off - off[0]
            sums = np.concatenate(([0], np.cumsum(equal)))
            rows = []
            for i in np.flatnonzero(sums[off[1:]] - sums[off[:-1]] >= least).tolist():
                first, end, same = best_overlap(equal[off[i]:off[i + 1]])
                if same >= least[i]:
                    rows.append((i, first, end - first, same))
            at, first, span, same = (pa.array([r[k] for r in rows], pa.int64()) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in names[:3]), pa.array(batch.column("place").take(at).to_numpy() + first.to_numpy()),
                 span, same, batch.column("item_words").take(at)], names=names)
        give_back()
    return near.mapInArrow(run, "key long, doc_id long, item_id long, place long, span long, n_equal long, item_words long")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(key, doc_id, item_id, place, span, n_equal, item_words)``: the largest overlap of each document with each benchmark item.

    ``place`` and ``span`` count words of the document, ``n_equal`` those of
    the span that are the item's.  Only pairs that overlap enough have a row.
    Null, empty and very short texts and items match nothing; items of one text
    are reported  ``key`` is ``keys.row_key`` of the row.
    Other columns are ignored.  An empty table on either side gives an empty
    result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", row_key(docs).alias("key"))
    words = stored(_words(items), "items")
    seeds = stored(_seeds(words), "seeds")
    lengths = [r[0] for r in words.select(F.least(F.size("words"), F.lit(_SHORT)).alias("n")).distinct().collect()]
    masks = [m for n in sorted(lengths) for m in _masks(n)] or _masks(_SHORT)
    regions = stored(_regions(docs, bitmap(seeds, "seed"), masks), "regions")

    hits = regions.select("key", "start", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select(
        "key", "start", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    lie = hits.join(seeds, "seed").select("key", "start", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    near = lie.join(regions.select("key", "doc_id", "start", "words").dropDuplicates(["key", "start"]), ["key", "start"]) \
        .join(words.select("item_id", F.col("words").alias("own")), "item_id")
    # Only the stretch in which region and item lie against each other goes on.
    head = F.greatest(F.lit(0), F.col("start") - F.col("diagonal"))
    n = F.least(F.size("own"), F.col("start") + F.size("words") - F.col("diagonal")) - head
    found = _verified(near.select(
        "key", "doc_id", "item_id", (head + F.col("diagonal")).alias("place"), F.size("own").cast("long").alias("item_words"),
        F.slice("words", (head + F.col("diagonal") - F.col("start") + 1).cast("int"), n.cast("int")).alias("words"),
        F.slice("own", (head + 1).cast("int"), n.cast("int")).alias("own")))
    best = F.max_by(F.struct("doc_id", "place", "span", "n_equal", "item_words"), F.struct("n_equal", -F.col("place")))
    return found.groupBy("key", "item_id").agg(best.alias("b")).select(
        "key", "b.doc_id", "item_id", "b.place", "b.span", "b.n_equal", "b.item_words")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no benchmark item."""
    bad = contaminated(docs, items).select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__at", row_key(docs)).join(bad, F.col("__at") == F.col("__key"), "left_anti").drop("__at")
