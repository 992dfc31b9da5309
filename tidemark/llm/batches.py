"""Arrow batches of texts for the Python stages, and vectorised words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text handled at once; a longer text is handled alone.
CHUNK = 250_000
#: Bytes hashed at once.
BLOCK = 1 << 20

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most ``rows`` rows and about ``limit`` characters, and their texts
    (null: empty). Only one slice's texts are Python objects at a time."""
    for batch in batches:
        for place in range(0, batch.num_rows, rows):
            part = batch.slice(place, rows)
            texts = ["" if t is None else t for t in part.column(column).to_pylist()]
            first, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= limit or i + 1 == len(texts):
                    yield part.slice(first, i + 1 - first), texts[first : i + 1]
                    first, held = i + 1, 0


def aside(df: DataFrame, read: Iterable[str], made: Iterable[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``df`` with all columns that it does not read under names of their own, then with the old
    names again. Columns named as those it makes are dropped first, unless it reads them; so no
    other column can clash with a name that ``work`` uses inside."""
    read, made = set(read), set(made)
    df = df.drop(*[c for c in df.columns if c in made - read])
    names = {c: f"column {i} aside" for i, c in enumerate(df.columns) if c not in read}
    hidden = df.withColumnsRenamed(names)
    out = work(hidden)
    return out.select(*[c for c in out.columns if c in made or c in hidden.columns]).withColumnsRenamed({v: k for k, v in names.items()})


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_values = mix64(np.arange(1, 257, dtype=U64) * U64(_P))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


class Words:
    """The words of a list of texts: runs of bytes that ``table`` does not map to 0.

    ``start``/``end`` are byte places in ``raw`` (the texts joined by one space), ``hash`` a 64-bit
    hash of each word's mapped bytes, ``first`` the index of each text's first word (one more
    entry than texts). Hashes are the same in every process.
    """

    def __init__(self, texts: list[str], table: np.ndarray, hashed: bool = True):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b" ".join(encoded) + b" "
        self.byte = table[np.frombuffer(self.raw, np.uint8)]
        inside = (self.byte != 0).view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        sizes = np.array([len(e) + 1 for e in encoded], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        if hashed:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Sums of powers over each word's bytes, block by block, so that a text of any length needs the
        memory of one block besides what each word needs."""
        up, down = _power(BLOCK)
        totals = np.empty((2, len(self.start)), U64)
        back = np.empty(len(self.start), U64)
        run = U64(0)
        for at in range(0, max(1, len(self.byte)), BLOCK):
            part = self.byte[at : at + BLOCK]
            lead, lag = U64(pow(_P, at, 1 << 64)), U64(pow(_P_INV, at, 1 << 64))
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_values[part] * up[: len(part)], dtype=U64, out=total[1:])
            total = run + total * lead
            for places, out in ((self.start, totals[0]), (self.end, totals[1])):
                a, b = np.searchsorted(places, [at, at + len(part)])
                out[a:b] = total[places[a:b] - at]
                if places is self.start:
                    back[a:b] = down[places[a:b] - at] * lag
            run = total[-1]
        return mix64((totals[1] - totals[0]) * back + (self.end - self.start).astype(U64))


_BREAK = re.compile(r"[\x20\x09-\x0D]")


def pieces(text: str, limit: int = 4 * CHUNK) -> list[str]:
    """A text in parts of about ``limit`` characters that add up to it, cut after ASCII white space, so
    that no word is divided. A short text is one part."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _BREAK.search(text, at + limit)
        if m is None:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def lower_table(words: str) -> np.ndarray:
    """A byte table that lower-cases A-Z and maps what stands outside words to 0.

    ``space``: words are runs of anything but ASCII white space; ``alnum``: runs of ASCII
    letters, digits and all non-ASCII characters.
    """
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if words == "space":
        t[[9, 10, 11, 12, 13, 32]] = 0
        t[0] = 255  # the byte 0 is a word's byte here; 255 occurs in no UTF-8
    else:
        t[:48] = 0
        t[58:65] = 0
        t[91:97] = 0
        t[123:128] = 0
    return t


def plain_table() -> np.ndarray:
    """``lower_table("space")`` with letters as they are."""
    t = lower_table("space")
    t[65:91] = np.arange(65, 91)
    return t


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for rows of non-null longs: the 64-bit XXH of each, seeded by the one before (the first by 42)."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values
    turn = lambda x, k: (x << U64(k)) | (x >> U64(64 - k))
    h = np.full(len(columns[0]), 42, U64)
    for c in columns:
        h = h + p5 + U64(8)
        h ^= turn(np.asarray(c, np.int64).view(U64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        h ^= h >> U64(32)
    return h
