"""Vectorised 64-bit hashes of words and word n-grams in Arrow string columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  White space is
ASCII, so words found on UTF-8 bytes are the words of the text.  The hash of
a word is a polynomial in its bytes modulo 2^64, taken from prefix sums of
the whole block and then mixed.  Work goes block by block, so the extra
memory is a small multiple of ``BLOCK`` beside one long per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_STEP = 0xD1342543DE82EF95
_TABLES: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, 0 to n."""
    if not _TABLES or len(_TABLES[0]) <= n:
        size = max(n + 1, BLOCK + 4096)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        up = np.full(size, _BASE, U64)
        down = np.full(size, inverse, U64)
        up[0] = down[0] = 1
        _TABLES[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _TABLES[0], _TABLES[1]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if off is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def _spaces(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b - np.uint8(9)) < 5)


def word_bounds(raw: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``raw``, in which documents begin at ``heads``."""
    n = len(raw)
    gap = np.ones(n + 1, bool)
    gap[:n] = _spaces(raw)
    edge = np.zeros(n + 1, bool)
    edge[heads] = True
    edge[0] = edge[n] = True
    solid = ~gap
    starts = np.flatnonzero(solid[:n] & (edge[:n] | np.concatenate(([True], gap[:n - 1])))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid[:n] & (edge[1:] | gap[1:])) + 1 if n else np.zeros(0, np.int64)
    return starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """One mixed 64-bit hash for each word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        block = raw[base:ends[j - 1]]
        if lower:
            block = np.where((block - np.uint8(65)) < 26, block + np.uint8(32), block)
        up, down = powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, U64)
        np.cumsum((block.astype(U64) + U64(1)) * up[:len(block)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive words; by prefix sums, so its cost does not grow with ``n``."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = powers(min(len(words), BLOCK) + 1)
    if len(words) <= BLOCK:
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[:len(words)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[:len(words) - n + 1] + U64(n * _STEP % (1 << 64)))
    parts = [gram_hashes(words[i:i + BLOCK], n) for i in range(0, len(words) - n + 1, BLOCK - n + 1)]
    return np.concatenate(parts)[:len(words) - n + 1]


class Documents:
    """The words of one slice of a string column: ``words[bounds[i]:bounds[i + 1]]`` are those of row ``first + i``."""

    def __init__(self, first: int, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        self.first, self.raw, self.offsets = first, raw, offsets
        heads = offsets[:-1][offsets[:-1] < len(raw)]
        self.starts, self.ends = word_bounds(raw, heads)
        self.words = word_hashes(raw, self.starts, self.ends, lower)
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every run of ``n`` words that lies in one row; runs that cross rows are left out."""
        hashes = gram_hashes(self.words, n)
        rows = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        whole = rows[:len(hashes)] == rows[n - 1:n - 1 + len(hashes)]
        return hashes[whole], rows[:len(hashes)][whole]


def slices(col: pa.Array, lower: bool, block: int = BLOCK) -> Iterator[Documents]:
    """The column in slices of about ``block`` bytes, whole rows each."""
    offsets, raw = string_buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        yield Documents(i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower)
        i = j
