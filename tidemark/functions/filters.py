"""Bloom filters of hashes: built as an aggregate, sized by the count, applied by the tasks that scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bits of a filter as powers of two: at least, and at most (16 MB); bits to a key up to there; bits set for a key.
LEAST, MOST, PER_KEY, SET = 20, 27, 8, 3


def _size(rows: int) -> int:
    return min(MOST, max(LEAST, (PER_KEY * max(1, rows) - 1).bit_length()))


def bloom(keys: DataFrame, column: str, rows: int) -> np.ndarray:
    """The filter of the 64-bit hashes in ``column``, about ``rows`` of them, as packed bits.

    Tasks or their keys' bits together, and the driver gets the words of the filter, at most 16 MB. With more keys than it has
    room for it lets more through, so whatever follows must be right without it.
    """
    size = _size(rows)
    h = F.col(column)
    places = F.array(*[F.shiftrightunsigned(F.shiftleft(h, 20 * i), 64 - size) for i in range(SET)])
    placed = keys.where(h.isNotNull()).select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    found = placed.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (size - 6), U64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(U64)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of these hashes; never false for one that it was built from."""
    size = len(bits).bit_length() + 5
    hashes = hashes.view(U64)
    out = np.ones(len(hashes), bool)
    for i in range(SET):
        at = (hashes << U64(20 * i)) >> U64(64 - size)
        out &= (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0
    return out
