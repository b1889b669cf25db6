"""A bitmap over 64-bit hashes that tells which are surely not in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.text_hash import U64

#: Bits of the smallest and of the largest bitmap (2 MB and 16 MB); beyond, it lets more pass, which costs time but changes no result.
LEAST, MOST = 24, 27


class Bitmap:
    """Two probes of 2^bits bits for each hash; sent to tasks packed."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def _probe(self, hashes: np.ndarray, down: int) -> np.ndarray:
        at = (hashes >> U64(down)) & U64((1 << self.bits) - 1)
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be in the table."""
        first = np.flatnonzero(self._probe(hashes, 64 - self.bits))
        return first[self._probe(hashes[first], 8)]


def bitmap(hashes: DataFrame, column: str) -> Bitmap:
    """Built by a grouped OR; at most 2^MOST / 64 rows reach the driver, however many hashes there are."""
    bits = min(MOST, max(LEAST, (16 * hashes.count()).bit_length()))
    low = F.lit((1 << bits) - 1)
    probe = F.explode(F.array(F.shiftrightunsigned(column, 64 - bits), F.shiftrightunsigned(column, 8).bitwiseAND(low)))
    rows = hashes.select(probe.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros((1 << bits) // 64, U64)
    words[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return Bitmap(bits, words)
