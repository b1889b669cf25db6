"""Stupid-backoff scores of documents from counts over all the other documents.

The text is dealt to blocks of about ``BLOCK_BYTES``.  Each block asks for the
counts of its distinct words and word pairs, one packed row for each shard of
the hash space; a shard sums the counts of all blocks and answers each block
with the totals that differ from the block's own.  The answers are joined to
the n-grams of the block's documents, and the scores summed for each document.
So an n-gram crosses the network once for each block that has it, not once for
each place, and those that only one block has get no answer.

The counts of a document leave out the document itself; else it would have
seen all its own n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.text_hash import U64, gram_hashes, slices

BACKOFF = 0.4
BLOCK_BYTES = 24 << 20
#: N-grams that a shard holds, about.
SHARD_GRAMS = 3_000_000

_SIZES = "words long, bytes long"
_ASKED = "shard long, block long, grams array<long>, counts array<int>"
_SCORED = "doc_id long, n_words long, n_backed_off long, log_score double"


def _sizes(docs: DataFrame) -> tuple[int, int]:
    def run(batches):
        for batch in batches:
            words = size = 0
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                words, size = words + len(raw.split()), size + len(raw)
            yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([size], pa.int64())], names=["words", "bytes"])
    row = docs.select("text").mapInArrow(run, _SIZES).agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")).first()
    return row["words"] or 0, row["bytes"] or 0


def _grams(part, i: int) -> tuple[np.ndarray, np.ndarray]:
    words = part.words[part.bounds[i]:part.bounds[i + 1]]
    return gram_hashes(words, 1), gram_hashes(words, 2)


def _counted(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and pairs of a block, sorted by hash, and how often it has them."""
    keys, counts = [], []
    for part in slices(text, lower=False):
        rows = np.repeat(np.arange(len(part)), np.diff(part.bounds))
        two = gram_hashes(part.words, 2)
        both = np.concatenate((gram_hashes(part.words, 1), two[rows[:-1] == rows[1:]] if len(rows) > 1 else two[:0]))
        k, c = np.unique(both, return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first))


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_backed_off, log_score, mean_log_score)`` for each row of ``docs(doc_id, text, ...)``.

    ``log_score`` sums over the words the log of c(pair) / c(first word) if
    the pair occurs in another document, else of 0.4 c(word) / N; a first
    word has no pair and takes c(word) / N; a word that no other document has
    counts as a half.  A null, empty or white-space text has no words, score
    0 and a null mean.  Repeated rows are separate documents.  Null doc_ids
    are passed through; other columns are ignored.  An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_words, n_bytes = _sizes(docs)
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    shards = max(1, -(-2 * n_words // SHARD_GRAMS))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)))

    def ask(table: pa.Table) -> pa.Table:
        keys, counts = _counted(table.column("text"))
        shard = (keys % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        which, first = np.unique(shard[order], return_index=True)
        ends = [*first[1:], len(order)]
        parts = [order[a:b] for a, b in zip(first, ends, strict=True)]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array(which, pa.int64()), pa.array([block] * len(which), pa.int64()),
                         _lists([keys[p].view(np.int64) for p in parts], pa.int64()), _lists([counts[p].astype(np.int32) for p in parts], pa.int32())],
                        names=["shard", "block", "grams", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blocks_of = table.column("block").to_pylist()
        grams, counts = (c.chunk(0) if c.num_chunks else c for c in (table.column("grams"), table.column("counts")))
        ends = np.asarray(grams.offsets)
        flat, n = np.asarray(grams.values).view(U64)[ends[0]:ends[-1]], np.asarray(counts.values)[ends[0]:ends[-1]].astype(np.int64)
        ends = ends - ends[0]
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        totals = np.empty(len(flat), np.int64)
        totals[order] = np.add.reduceat(n[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        more = totals > n
        keep = [a + np.flatnonzero(more[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        # An n-gram is named by its place in the list that its block sent, as the step from the one before.
        steps = [np.diff(k, prepend=a - 1).astype(np.int32) for k, a in zip(keep, ends[:-1], strict=True)]
        return pa.table([pa.array(blocks_of, pa.int64()), table.column("shard"), _lists(steps, pa.int32()), _lists([totals[k] for k in keep], pa.int64())],
                        names=["block", "shard", "steps", "totals"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = _counted(left.column("text"))
        right = right.combine_chunks()
        if len(right):
            order = np.argsort((keys % U64(shards)).astype(np.int64), kind="stable")
            first = np.concatenate(([0], np.cumsum(np.bincount((keys % U64(shards)).astype(np.int64), minlength=shards))))
            for shard, steps, totals in zip(right.column("shard").to_pylist(), right.column("steps"), right.column("totals"), strict=True):
                counts[order[first[shard] - 1 + np.cumsum(steps.values.to_numpy())]] = totals.values.to_numpy()
        out: list[tuple[int, int, float]] = []
        for part in slices(left.column("text"), lower=False):
            for i in range(len(part)):
                out.append(_score(*_grams(part, i), keys, counts, n_words))
        return pa.table([left.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))],
                        names=["doc_id", "n_words", "n_backed_off", "log_score"])

    answers = dealt.groupBy("block").applyInArrow(ask, _ASKED).groupBy("shard").applyInArrow(
        answer, "block long, shard long, steps array<int>, totals array<long>")
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORED)
    return found.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def _score(one: np.ndarray, two: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[int, int, float]:
    n = len(one)
    if not n:
        return 0, 0, 0.0

    def others(grams: np.ndarray) -> np.ndarray:
        own, back, c = np.unique(grams, return_inverse=True, return_counts=True)
        return (counts[np.searchsorted(keys, own)] - c)[back]
    word, pair = others(one), others(two) if len(two) else np.zeros(0, np.int64)
    share = np.maximum(word, 0.5) / max(n_words - n, 1)
    share[1:] *= BACKOFF
    seen = pair > 0
    share[1:][seen] = pair[seen] / word[:-1][seen]
    return n, int(n - 1 - seen.sum()), float(np.log(share).sum())
