"""Keys and sets of texts: normal forms, core keys, windows, hashed n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import md5_number


def normal_key(text: Column) -> Column:
    """A hash of letters and digits alone, of any script, lower-cased: spellings of one item
    collapse. Null where nothing is left, so that such texts are no family."""
    return F.md5(F.nullif(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", ""), F.lit("")))


def words(text: Column) -> Column:
    """Lower-case runs of letters (with their marks) and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)


def _windows(words: Column, width: int, of: Callable[[list[Column]], Column]) -> Column:
    n = F.greatest(F.size(words) - width + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(width)])
    return F.transform(shifted, lambda s: of([s[f"w{k}"] for k in range(width)]))


def windows(words: Column, width: int) -> Column:
    """All windows of ``width`` words, joined by a space; fewer words give none."""
    return _windows(words, width, lambda w: F.concat_ws(" ", *w))


#: Characters hashed at once; a longer text is hashed in parts.
CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter, a mark or a digit."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)


@lru_cache(2)
def _powers(base: int) -> np.ndarray:
    p = np.full(CHUNK + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def hash_words(low: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a text in lower case, and where they begin, by array operations over its characters."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(_letters()[points].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums, back = np.zeros((2, len(start)), np.uint64), np.zeros(len(start), np.uint64)
    total = np.uint64(0)
    for at in range(0, len(points), CHUNK):  # sums of powers, a part at a time
        part = points[at : at + CHUNK]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_mix(part.astype(np.uint64) + np.uint64(_P)) * _powers(_P)[: len(part)], dtype=np.uint64, out=run[1:])
        run = total + run * np.uint64(pow(_P, at, 1 << 64))
        for places, out in ((start, sums[0]), (end, sums[1])):
            i, j = np.searchsorted(places, [at, at + len(part)], "right" if places is end else "left")
            out[i:j] = run[places[i:j] - at]
            if places is start:
                back[i:j] = _powers(_P_INV)[places[i:j] - at] * np.uint64(pow(_P_INV, at, 1 << 64))
        total = run[-1]
    return _mix(((sums[1] - sums[0]) * back) ^ (end - start).astype(np.uint64)), start


def hash_windows(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its windows of ``width`` words (as ``words`` defines
    them; fewer words and null give none). Texts are hashed together, up to ``CHUNK`` characters."""
    out: list[np.ndarray] = []
    first, held = 0, 0
    low = [(t or "").lower() for t in texts]
    for i, t in enumerate(low):
        held += len(t) + 1
        if held < CHUNK and i + 1 < len(low):
            continue
        some = low[first : i + 1]
        h, start = hash_words("\n".join(some))
        g = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width if len(g) else 0):
            g = (g ^ h[k : k + len(g)]) * np.uint64(_P)
            g ^= g >> np.uint64(29)
        bounds = np.searchsorted(start, np.cumsum([0, *[len(x) + 1 for x in some]])).tolist()
        out += [np.unique(g[a : max(a, b - width + 1)]).view(np.int64) for a, b in zip(bounds, bounds[1:])]
        first, held = i + 1, 0
    return out


def with_windows(df: DataFrame, text: str, width: int, name: str = "items") -> DataFrame:
    """``df`` without ``text``, with the distinct hashed windows of its words, by ``hash_windows`` in Arrow batches
    (some ten times as fast as array functions, which Spark interprets element by element)."""
    kept = [c for c in df.columns if c != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema) + f"`{name}` array<long>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                items = hash_windows(part.column(text).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(items, pa.list_(pa.int64()))], names=[*kept, name])

    return df.select(*kept, text).mapInArrow(run, schema)


def fingerprint(words: Column, width: int = 3, bits: int = 2048) -> Column:
    """I4: sorted distinct places of hashed word windows in a vector of ``bits`` bits."""
    return F.array_sort(F.array_distinct(F.transform(windows(words, width), lambda w: F.pmod(md5_number(w), F.lit(bits)).cast("int"))))


def descriptors(text: Column) -> list[Column]:
    """Numeric descriptors of a text; ratios of an empty or null text are 0."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    share = lambda pattern: F.when(size > 0, F.regexp_count(t, F.lit(pattern)) / size).otherwise(0.0)
    w = words(t)
    return [
        size.cast("long").alias("length"),
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.split(t, "\n")).cast("long").alias("n_lines"),
        F.when(F.size(w) > 0, F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)) / F.size(w)).otherwise(0.0).alias("word_length"),
        share(r"\p{Lu}").alias("upper"),
        share(r"\p{N}").alias("digits"),
        share(r"[^\p{L}\p{M}\p{N}\s]").alias("marks"),
        share(r"\s").alias("spaces"),
    ]


def core_text(docs: DataFrame, key: str, text: str, least_df: int = 3, least_length: int = 20) -> DataFrame:
    """``(key, core_key, n_removed)``: lines that stand in ``least_df`` texts or more are decoration.

    The rest is hashed in line order; if it is too short the whole text is, so that nothing
    collapses to an empty core.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    common = lines.select(key, "line").distinct().groupBy("line").agg(F.count("*").alias("df")).where(F.col("df") >= least_df).select("line", F.lit(True).alias("_c"))
    marked = lines.join(common, "line", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("_c").isNull(), F.struct("at", "line"))))
    per = marked.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("core"), F.count_if("_c").alias("n_removed"))
    whole = docs.select(key, F.col(text).alias("_t")).join(per, key, "left")
    small = F.coalesce(F.length("core"), F.lit(0)) < least_length
    out = F.when(small, F.coalesce("_t", F.lit(""))).otherwise(F.col("core"))
    return whole.select(key, F.md5(out).alias("core_key"), F.when(small, 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"))
