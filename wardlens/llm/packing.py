"""Packing documents into sequences by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left
of it, and every shorter document, is one piece.  Pieces are placed from the
longest to the shortest into the open window with the least room that still
takes them, found by a segment tree indexed by remaining capacity.

The order of pieces of one length does not matter to the plan, so the plan is
made on the counts of pieces by length, at most ``window`` numbers whatever
the corpus: a run of windows of equal room takes a run of equal pieces at
once.  Each piece then finds its window by its rank among its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.storage import give_back, stored
from wardlens.llm.text_hash import string_buffers

WINDOW = 1024
END_ID = 0
#: Bytes of text that a task encodes together.
TOGETHER = 6 << 20
#: Rows of one length that one task ranks, about.
RANKED = 200_000


class RoomTree:
    """A segment tree over remaining capacities: the number of open windows of each, and the least that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, filled: bool) -> None:
        i = self.size + room
        self.any[i] = filled
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that an open window has."""
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, n, first_sequence, offset)``: ``n`` pieces of ``length``, by rank, go one each to so many sequences.

    Best-fit decreasing on runs of equal pieces and equal windows.
    """
    tree, rooms, out, opened = RoomTree(window), defaultdict(list), [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = window
                first, n = opened, -(-left // (window // length))
                opened += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            # A window that has taken a piece has the least room of those that fit, so it takes all it can before the next one.
            fits = room // length
            full = min(n, left // fits)
            rest = left - full * fits if full < n else 0
            for i in range(fits if full else 0):
                out.append((length, rank, full, first, window - room + i * length))
                rank += full
            give(room - fits * length, first, full)
            for i in range(rest):
                out.append((length, rank, 1, first + full, window - room + i * length))
                rank += 1
            if rest:
                give(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            give(room, first + used, n - used)
            left -= full * fits + rest
    return out


class Encoder:
    """Texts -> ids of a byte-level BPE vocabulary, ``<name>.json`` beside the same vocabulary as ranks in ``<name>.tiktoken``.

    Pre-tokens do not reach over white space, so in texts whose words are
    parted by single spaces and line ends each distinct word of a batch, with
    the space or line end before it, is encoded once; its ids end where the
    next id begins with white space.  Texts with any other white space, with a
    space or line end beside another or at an end, or with the string of a
    special token are encoded as a whole, special tokens to their own ids.
    """

    def __init__(self, name: str):
        import base64
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.ordinary = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        strings = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.parts = re.compile(f"({strings})") if strings else None
        # Written for RE2, whose \s is ASCII only.
        self.irregular = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z" \
            + (f"|{strings}" if strings else "")
        self.leads = np.zeros(max(ranks.values()) + 1, bool)
        self.leads[[v for k, v in ranks.items() if k[:1] in (b" ", b"\n")]] = True

    def encode(self, text: str) -> list[int]:
        if self.parts is None:
            return self.ordinary(text)
        ids = []
        for i, part in enumerate(self.parts.split(text)):
            ids += [self.special[part]] if i % 2 else self.ordinary(part)
        return ids

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of words that each begin with a space or a line end."""
        offsets, data = string_buffers(words)
        parts = [np.array(self.ordinary(data[offsets[i]:offsets[min(i + 4096, len(words))]].tobytes().decode()), np.uint32)
                 for i in range(0, len(words), 4096)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.concatenate((np.flatnonzero(self.leads[ids]), [len(ids)]))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        items = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        simple = pc.invert(pc.match_substring_regex(texts, self.irregular)).to_numpy(zero_copy_only=False)
        bounds = np.asarray(items.offsets)
        follows = np.repeat(simple, np.diff(bounds))
        follows[bounds[:-1]] = False
        heads = items.values.take(pa.array(bounds[:-1])).to_pylist()
        coded = items.values.filter(pa.array(follows)).dictionary_encode()
        words = coded.dictionary
        ids, at = self.distinct(pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, ""))
        which = coded.indices.to_numpy()
        sizes = np.diff(at)[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = ids[np.repeat(at[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.concatenate(([0], np.cumsum(follows)))[bounds]]
        return [np.concatenate((np.array(self.encode(heads[i]), np.uint32), flat[cuts[i]:cuts[i + 1]])) if simple[i]
                else np.array(self.encode(texts[i].as_py()), np.uint32) for i in range(len(texts))]


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])`` of every piece; a null text is empty, so only its end id is left."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        encode = Encoder(vocabulary)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
                yield cut(encode, batch.column("doc_id").slice(a, b - a).to_pylist(), pc.fill_null(batch.column("text").slice(a, b - a), ""))
                a = b
            give_back()
        del encode
        give_back()

    def cut(encode, doc_ids, texts):
        rows = []
        for doc_id, ids in zip(doc_ids, encode(texts), strict=True):
            ids = np.append(ids, END_ID).astype("<u4")
            for a in range(0, len(ids), window):
                own = ids[a:a + window]
                rows.append((doc_id, a, len(own), zlib.crc32(own), len(ids)) + ((own.astype(np.int32),) if with_ids else ()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every piece of every row of ``docs(doc_id, text, ...)`` with its ``sequence_id`` and its ``offset`` there.

    Each row, repeated ones too, is a document of its ids and one end id; a
    null or empty text is the end id alone.  Null doc_ids are passed through.
    Other columns are ignored.  An empty table gives an empty result.  With
    ``with_ids`` the token ids are returned too.
    """
    cut = stored(pieces(docs, vocabulary, window, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    steps: dict[int, tuple[list[int], ...]] = {}
    for length, rank, _, sequence, offset in plan(counts, window):
        for column, value in zip(steps.setdefault(length, ([], [], [])), (rank, sequence, offset), strict=True):
            column.append(value)

    # The rank of a piece among its length: by hash shard, so that no length gathers in one task.
    shards = max(1, -(-max(counts.values(), default=1) // RANKED))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    sizes = sharded.groupBy("length", "shard").count()
    before = sizes.select("length", "shard", (F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = sharded.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "shard"]) \
        .withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "shard")

    names = cut.columns

    def place(batches):
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                ranks, sequences, offsets = steps[length]
                i = bisect_right(ranks, rank) - 1
                sequence.append(sequences[i] + rank - ranks[i])
                offset.append(offsets[i])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*names, "sequence_id", "offset"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
