"""Byte-pair encoding and decoding with a public vocabulary whose words carry an end mark.

A text is cut at white space, normalised (composed, lower case) and cut into
words, numbers' digits and runs of signs.  The bytes of each word, one sign for
a byte and the end mark on the last, are merged by contiguous rank arrays: the
parts of a word, one for each pair of neighbouring boundaries, and the rank of
every adjacent pair lie side by side; the least rank is found by a scan, its
boundary is deleted and the ranks on both sides are looked up anew.  Words of
one length lose a boundary in each round alike, so they share one matrix and
each step is done for all of them at once.  A scan of all ranks for each merge
suits short words only, so long ones keep their ranks in a heap instead, with
the same result.

Nothing of a text crosses white space, so each distinct word of a batch is
encoded once and the ids of the batch are gathered from those.  Encoding and
decoding need no shuffle.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: Words of more signs than this are merged by a heap.
SHORT = 128
#: Bytes of text that a task encodes together, and ids that it decodes together; whole rows each.
TOGETHER, IDS_TOGETHER = 3 << 20, 1 << 20
#: Places of the table of merges, a power of two and several times their number.
PLACES_BITS = 18
#: Fixed value: what counts as a word of this kind of vocabulary, in ASCII text in lower case.
ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"

_NEVER = np.int32(np.iinfo(np.int32).max)


def byte_signs() -> list[str]:
    """A printable sign for each byte: its own where it has one, and the next from U+0100 on for the others, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """The tokens, merges and special tokens of a vocabulary file of the public tokenizers."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            found = json.load(f)
        self.end = found["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = found["model"]["vocab"]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(found["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        strings = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.parts = re.compile(f"({strings})") if strings else None
        self.ascii_words = re.compile(ASCII_WORD + r"|\n")
        # Beyond ASCII the case and the classes of characters are those of the vocabulary's own normaliser, whose Unicode version is not Python's.
        library = Tokenizer.from_file(public_tokenizers.path(name))
        self.normalised, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        signs = byte_signs()
        self.signs = str.maketrans(dict(zip(map(chr, range(256)), signs, strict=True)))
        # The id of each sign, within a word and at its end; the table of merges, by the ids of both parts; the id that a merge makes.
        self.within, self.last = np.zeros(512, np.int32), np.zeros(512, np.int32)
        for sign in signs:
            self.within[ord(sign)], self.last[ord(sign)] = self.ids[sign], self.ids[sign + self.end]
        self.made = np.array([self.ids[a + b] for a, b in self.ranks], np.int32)
        self.pairs, self.pair_ranks = np.full(1 << PLACES_BITS, -1, np.int64), np.full(1 << PLACES_BITS, _NEVER, np.int32)
        for rank, (a, b) in enumerate(self.ranks):
            key = self.ids[a] << 20 | self.ids[b]
            at = int(self._places(np.array([key]))[0])
            while self.pairs[at] >= 0:
                at = (at + 1) % len(self.pairs)
            self.pairs[at], self.pair_ranks[at] = key, rank

    def tokens(self) -> pa.Array:
        """The string of each id; null where an id has none."""
        by_id = {i: t for t, i in (self.ids | self.special).items()}
        return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())

    @staticmethod
    def _places(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; ``_NEVER`` where no merge joins them."""
        keys = left.astype(np.int64) << 20 | right
        at = self._places(keys)
        there = self.pairs[at]
        out = np.where(there == keys, self.pair_ranks[at], _NEVER)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.pairs)
            there = self.pairs[at[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.pair_ranks[at[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out

    def merged(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length, a row of ids each -> the ids left, one word after another, and how many each word has."""
        n = len(ids)
        sizes, out = np.zeros(n, np.int64), np.zeros(ids.shape, np.int32)
        which = np.arange(n)
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
        while len(which):
            width = ids.shape[1]
            least = ranks.argmin(1) if width > 1 else np.zeros(len(which), np.int64)
            row = np.arange(len(which))
            best = ranks[row, least] if width > 1 else np.full(len(which), _NEVER)
            done = best == _NEVER
            sizes[which[done]] = width
            out[which[done], :width] = ids[done]
            live = ~done
            which, ids, ranks, least, best = which[live], ids[live], ranks[live], least[live], best[live]
            if not len(which):
                break
            row = np.arange(len(which))
            ids[row, least] = self.made[best]
            keep = np.ones(ids.shape, bool)
            keep[row, least + 1] = False
            ids = ids[keep].reshape(len(which), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, least] = False
            ranks = ranks[keep].reshape(len(which), width - 2)
            left = np.flatnonzero(least > 0)
            ranks[left, least[left] - 1] = self.rank(ids[left, least[left] - 1], ids[left, least[left]])
            right = np.flatnonzero(least < width - 2)
            ranks[right, least[right]] = self.rank(ids[right, least[right]], ids[right, least[right] + 1])
        return out[np.arange(out.shape[1]) < sizes[:, None]], sizes

    def merged_long(self, word: str) -> list[int]:
        """The ids of one long word: the least rank, leftmost first, comes from a heap; stale entries are told by the boundaries they were made of."""
        text, get = word + self.end, self.ranks.get
        after = [*range(1, len(word)), len(text)]
        before = [*range(-1, len(word) - 1)]
        gone = [False] * len(word)
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(word):
                rank = get((text[a:b], text[b:after[b]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, after[b]))
        for a in range(len(word) - 1):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if gone[a] or after[a] != b or after[b] != c:
                continue
            gone[b], after[a] = True, c
            if c < len(word):
                before[c] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        bounds = [*(a for a in range(len(word)) if not gone[a]), len(text)]
        return [self.ids[text[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, given by the signs of their bytes, one word after another, and where each begins."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        heads = np.concatenate(([0], np.cumsum(lengths)))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes, found = np.zeros(len(words), np.int64), []
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            if length <= SHORT:
                signs = codes[heads[own][:, None] + np.arange(length)]
                ids = self.within[signs]
                ids[:, -1] = self.last[signs[:, -1]]
                flat, sizes[own] = self.merged(ids)
            else:
                each = [self.merged_long(words[i]) for i in own]
                sizes[own] = list(map(len, each))
                flat = np.fromiter((i for x in each for i in x), np.int32, sizes[own].sum())
            found.append((own, flat))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.zeros(starts[-1], np.int32)
        for own, flat in found:
            out[_runs(starts[own], sizes[own])] = flat
        return out, starts

    def words(self, text: str) -> list[str]:
        """The words of a text without ASCII white space, by the signs of their bytes."""
        if text.isascii():
            found = self.ascii_words.findall(text.lower())
            return found if text.isprintable() else [w.translate(self.signs) for w in found]
        return [w for w, _ in self.cut(self.normalised(text))]

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without ASCII white space, one after another, and where each begins; strings of special tokens are these tokens."""
        plain = [t for t in texts if t.isascii() and t.isprintable()]
        joined = "\n".join(plain)
        if self.parts is not None and self.parts.search(joined):
            plain = [t for t in plain if not self.parts.search(t)]
            joined = "\n".join(plain)
        # Words of all plain texts at once; a line end parts one text from the next.
        words = self.ascii_words.findall(joined.lower())
        of_plain = set(plain)
        others: list[list] = []
        for text in texts:
            if text not in of_plain:
                own: list = []
                for i, part in enumerate(self.parts.split(text) if self.parts else [text]):
                    own += [self.special[part]] if i % 2 else self.words(part)
                others.append(own)
        coded = pa.array(words + [w for own in others for w in own if isinstance(w, str)], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at_break = distinct.index("\n") if "\n" in distinct else -1
        ids, starts = self.word_ids([w if w != "\n" else "!" for w in distinct])
        which = coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(starts)[which]
        breaks = which[:len(words)] == at_break
        sizes[:len(words)][breaks] = 0
        text_of = np.cumsum(breaks)
        out_sizes = np.zeros(len(texts), np.int64)
        is_plain = np.fromiter((t in of_plain for t in texts), bool, len(texts))
        order = np.flatnonzero(is_plain)
        if len(order):
            out_sizes[order] = np.bincount(text_of, sizes[:len(words)], len(order)).astype(np.int64) if len(words) else 0
        flat = ids[_runs(starts[which], sizes)]
        cut = int(sizes[:len(words)].sum())
        rest, at, lists = flat[cut:], 0, []
        word_sizes = iter(sizes[len(words):].tolist())
        for own in others:
            mine: list[int] = []
            for w in own:
                if isinstance(w, str):
                    k = next(word_sizes)
                    mine += rest[at:at + k].tolist()
                    at += k
                else:
                    mine.append(w)
            lists.append(mine)
        out_sizes[~is_plain] = list(map(len, lists))
        heads = np.concatenate(([0], np.cumsum(out_sizes)))
        out = np.zeros(heads[-1], np.int32)
        out[_runs(heads[:-1][is_plain], out_sizes[is_plain])] = flat[:cut]
        out[_runs(heads[:-1][~is_plain], out_sizes[~is_plain])] = np.fromiter((i for x in lists for i in x), np.int32)
        return out, heads

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = cut.flatten().dictionary_encode()
        ids, heads = self.stretches(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        sizes = np.diff(heads)[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        offsets = np.asarray(cut.offsets)
        return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), pa.array(ids[_runs(heads[:-1][which], sizes)], pa.int32()))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@functools.cache
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


@functools.cache
def _tokens(name: str) -> pa.Array:
    return _vocabulary(name).tokens()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` of each row of ``docs(doc_id, text, ...)``: the ids of the whole text, without tokens added around it.

    A null, empty or white-space text has no ids.  Null doc_ids are passed
    through, repeated rows are encoded each, other columns are ignored, and an
    empty table gives an empty result.  ``vocabulary`` names a file of the
    public tokenizers with lower-case words that carry an end mark.
    """
    def run(batches):
        coder = _vocabulary(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), coder.encode(texts.slice(a, b - a))], names=["doc_id", "ids"])
                a = b
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``coded(doc_id, ids, ...)`` -> ``(doc_id, ids, text)``: the strings of all tokens, special ones too, parted by single spaces.

    The vocabulary names no decoder, so end marks stay.  Ids without a token,
    null ones too, are left out; a null list has the empty text.
    """
    def run(batches):
        tokens = _tokens(vocabulary)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy())
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + IDS_TOGETHER, "right")))
                yield joined(tokens, batch.slice(a, b - a))
                a = b

    def joined(tokens, batch):
        lists = batch.column("ids")
        flat = lists.flatten()
        known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
        strings = tokens.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
        held = np.concatenate(([0], np.cumsum(strings.is_valid().to_numpy(zero_copy_only=False))))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        bounds = held[np.concatenate(([0], np.cumsum(sizes)))]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), strings.drop_null()), " ")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, text], names=["doc_id", "ids", "text"])
    return coded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")
