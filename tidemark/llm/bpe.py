"""Byte-level BPE: vectorised pre-tokenisation, cached merging, decoding by offsets."""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import chunks
from tidemark.session import table

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, END, APOSTROPHE = range(7)
# Symbols: a class with what follows taken into account.
S_LETTER, S_NUMBER, S_OTHER, S_LEAD, S_LAST, S_RUN, S_SHORT, S_LONG, S_END = range(9)
# States: between tokens; in a letter, number or other run; after a leading space; in white
# space; with one or two letters of a contraction to come.
Q_NONE, Q_LETTER, Q_NUMBER, Q_OTHER, Q_LEAD, Q_BLANK, Q_ONE, Q_TWO = range(8)
STATES, SYMBOLS = 8, 9
#: Characters in a lane of the scan.
LANE = 512
#: Cached slices in a worker.
CACHE = 1 << 20
#: Characters encoded at once; longer texts go in parts of so many.
SLICE, LONG = 250_000, 1_000_000
_BETWEEN = re.compile("[A-Za-z](?= [A-Za-z])")

# The code points with the White_Space property.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    first = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    t[WHITE] = BLANK
    t[32] = SPACE
    t[39] = APOSTROPHE
    return t


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """``next[state, symbol]`` and ``starts[state, symbol]`` (a token begins here)."""
    go = np.zeros((STATES, SYMBOLS), np.uint8)
    starts = np.ones((STATES, SYMBOLS), bool)
    go[:, S_LETTER], go[:, S_NUMBER], go[:, S_OTHER] = Q_LETTER, Q_NUMBER, Q_OTHER
    go[:, S_LEAD], go[:, S_LAST], go[:, S_RUN], go[:, S_END] = Q_LEAD, Q_NONE, Q_BLANK, Q_NONE
    go[:, S_SHORT], go[:, S_LONG] = Q_ONE, Q_TWO
    for state, symbol in ((Q_LETTER, S_LETTER), (Q_NUMBER, S_NUMBER), (Q_OTHER, S_OTHER), (Q_BLANK, S_RUN)):
        starts[state, symbol] = False
    for symbol in (S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG):  # what a leading space joins
        starts[Q_LEAD, symbol] = False
    for symbol in (S_SHORT, S_LONG):  # within a run of others an apostrophe is one more of them
        for state in (Q_OTHER, Q_LEAD):
            go[state, symbol] = Q_OTHER
            starts[state, symbol] = False
    go[Q_ONE, S_LETTER], go[Q_TWO, S_LETTER] = Q_NONE, Q_ONE
    starts[Q_ONE, S_LETTER] = starts[Q_TWO, S_LETTER] = False
    return go, starts


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each character; ``ends`` are places of text ends."""
    c = class_table()[points]
    c[ends] = END
    s = np.array([S_LETTER, S_NUMBER, S_OTHER, S_LEAD, S_LAST, S_END, S_OTHER], np.uint8)[c]
    after = np.append(c[1:], END)
    blank = (c == SPACE) | (c == BLANK)
    s[blank & ((after == SPACE) | (after == BLANK) | (after == END))] = S_RUN
    at = np.flatnonzero(c == APOSTROPHE)
    if len(at):
        padded = np.append(points, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        s[at[np.isin(one, [ord(x) for x in "stmd"])]] = S_SHORT
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        s[at[long]] = S_LONG
    return s


def boundaries(s: np.ndarray) -> np.ndarray:
    """Places where tokens begin.

    Each character is a function from states to states; functions compose associatively, so
    lanes of ``LANE`` characters are composed side by side, the lanes' functions are applied one
    after the other to get each lane's first state, and a second pass runs all lanes from there.
    """
    go, starts = machine()
    go_flat = (go.astype(np.uint8) * SYMBOLS).ravel()  # states are held times SYMBOLS
    lanes = -(-len(s) // LANE)
    grid = np.full(lanes * LANE, S_END, np.uint8)
    grid[: len(s)] = s
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    whole = np.repeat((np.arange(STATES, dtype=np.uint8) * SYMBOLS)[:, None], lanes, axis=1)
    for row in grid:
        whole = go_flat[whole + row]
    first = np.zeros(lanes, np.uint8)
    state = Q_NONE
    for k, step in enumerate((whole // SYMBOLS).T.tolist()):
        first[k] = state
        state = step[state]
    begin = np.empty((LANE, lanes), bool)
    now = first * np.uint8(SYMBOLS)
    flat = starts.ravel()
    for j, row in enumerate(grid):
        at = now + row
        begin[j] = flat[at]
        now = go_flat[at]
    return np.flatnonzero(begin.T.ravel()[: len(s)])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank, leftmost first, is joined until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) <= 48:
        return _merge_short(piece, ranks)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
            heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
    return [ranks[p] for p in parts if p is not None]


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short slice: plain lists beat a heap there."""
    get, none = ranks.get, len(ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Vocabulary(dict):
    """Slice to packed ids, filled as slices come; and the bytes of all ids end to end."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1  # ranks run from 0 without gaps
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """Packed ids of each text, and the places where its slices begin. A very long text goes part by
        part, cut where a slice begins whatever stands around: before a space between letters."""
        if all(len(t) <= LONG for t in texts):
            return self._encode(texts)
        whole = []
        for t in texts:
            parts = [0]
            while len(t) - parts[-1] > LONG and (m := _BETWEEN.search(t, parts[-1] + LONG)):
                parts.append(m.end())
            each = [self._encode([t[a:b]]) for a, b in zip(parts, [*parts[1:], len(t)])]
            whole.append((b"".join(ids for (ids,), _ in each), np.concatenate([p + a for a, (_, (p,)) in zip(parts, each)])))
        return [ids for ids, _ in whole], [p for _, p in whole]

    def _encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        if len(self) > CACHE:
            self.clear()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begin = boundaries(symbols(points, ends))
        bound = begin.tolist()
        pieces = [joined[a:b] for a, b in zip(bound, bound[1:] + [len(joined)])]
        last = np.searchsorted(begin, ends).tolist()
        get, out, places, at, base = self.__getitem__, [], [], 0, 0
        for stop, end in zip(last, ends.tolist()):
            out.append(b"".join(map(get, pieces[at:stop])))
            places.append(begin[at:stop] - base)
            at, base = stop + 1, end + 1  # the text end is a slice of its own
        return out, places

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids, gathered by their offsets in the vocabulary."""
        which = np.frombuffer(ids, "<u4")
        length = self.length[which]
        stop = np.cumsum(length)
        shift = np.repeat(self.offset[which] - (stop - length), length)
        return self.blob[shift + np.arange(len(shift))].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", slices: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (packed little-endian unsigned 32-bit) and ``n_tokens``.

    With ``slices``, also ``slice_starts`` (packed the same way): the character at which each
    pre-token begins. With ``decoded``, also ``decoded``: the bytes that the ids stand for, decoded
    in the same pass. A null or empty text has no ids; repeated rows have the same; an empty
    table gives an empty result. Columns of those names are replaced, others kept. The
    vocabulary file must be at ``path`` on every machine; without one each worker looks up the public file.
    """
    made = {"ids": "binary", "n_tokens": "bigint"} | ({"slice_starts": "binary"} if slices else {}) | ({"decoded": "binary"} if decoded else {})
    source = docs.drop(*[c for c in made if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + "".join(f", {n} {t}" for n, t in made.items())
    names = source.columns + list(made)

    def run(batches):
        words = vocabulary(path or default_path())
        for part, texts in chunks(batches, text, SLICE):
            ids, places = words.encode(texts)
            cols = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
            if slices:
                cols.append(pa.array([p.astype("<u4").tobytes() for p in places], pa.binary()))
            if decoded:
                cols.append(pa.array([words.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(list(part.columns) + cols, names=names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of each row's ids (null ids: none)."""
    source = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", decoded binary"
    names = [*source.columns, "decoded"]

    def run(batches):
        words = vocabulary(path or default_path())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [words.decode(x or b"") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(out, pa.binary())], names=names)

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = "") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document; both passes in one worker."""
    both = encode(docs.select("doc_id", "text"), path, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
