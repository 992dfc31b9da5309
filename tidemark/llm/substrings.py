"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of the runs of ``GRAM`` words
within it; consecutive windows of one minimiser form a super-k-mer. Equal windows have equal
minimisers, so:

1. Minimisers are counted. Windows of a minimiser that occurs once in the corpus have no equal: most texts end here.
2. Super-k-mers of the others are counted. One that occurs again is a repeat as a whole in all
   places but its first; its words need not be seen for that. So groups of copies cost a row a place.
3. Only where one minimiser has unlike super-k-mers, or one has equal windows inside, do words travel: the first
   occurrence of each super-k-mer goes as one packed string to the bucket of its minimiser, where sorting the
   windows tells which occur before.
4. A bucket beyond ``HOT`` super-k-mers (a line that very many texts have, each with other neighbours) is split
   further: its windows go one by one to sub-buckets of their own hash, with the least place combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.functions.filters import bloom, may_hold
from tidemark.llm.batches import U64, Words, aside, chunks, hash_longs, mix64, pieces, plain_table
from tidemark.operators.ranking import global_rank
from tidemark.session import cut, release, scratch, table

#: Words of a window, and of the runs whose least hash is its minimiser.
WINDOW, GRAM = 20, 8
#: Windows of a super-k-mer, at most; windows of a text that are looked at in one step.
LONGEST, STEP = 256, 1 << 17
#: Super-k-mers that the bucket of one minimiser sorts; larger buckets are split by window.
HOT = 20_000
#: Bytes of packed strings that a worker sorts at once, about.
SORTED = 4_000_000
#: Place of rows without an id: after all others.
LAST = (1 << 63) - 1

_TABLE = plain_table()
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
_MULT = mix64(np.arange(1, GRAM + 1, dtype=U64)) | U64(1)
_A = 0xD1B54A32D192ED03
_A_INV = pow(_A, -1, 1 << 64)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[:1] = 1
    return np.cumprod(p, dtype=U64)


_UP, _DOWN = _powers(_A, STEP + WINDOW), _powers(_A_INV, STEP + WINDOW)


def _sequence(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, from the words' hashes."""
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _UP[: len(h)], dtype=U64, out=total[1:])
    return mix64((total[first + length] - total[first]) * _DOWN[first] + length.astype(U64))


def superkmers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``minimiser, hash, first word, windows, repeats inside`` of a text, from its words' hashes."""
    found = [_superkmers(h[at : at + STEP + WINDOW - 1], at) for at in range(0, max(1, len(h) - WINDOW + 1), STEP)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _superkmers(h: np.ndarray, base: int):
    n = len(h) - WINDOW + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (U64, U64, np.int64, np.int64, bool))
    g = np.zeros(len(h) - GRAM + 1, U64)
    for k in range(GRAM):
        g += h[k : k + len(g)] * _MULT[k]
    low, span, goal = mix64(g), 1, WINDOW - GRAM + 1
    while span < goal:  # minima of runs, by doubling
        step = min(span, goal - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    length = np.diff(starts, append=n)
    if length.max() > LONGEST:
        cuts = [np.arange(a, a + w, LONGEST) for a, w in zip(starts.tolist(), length.tolist())]
        starts = np.concatenate(cuts)
        length = np.diff(starts, append=n)
    window = _sequence(h, np.arange(n), np.full(n, WINDOW))
    tagged = mix64(window) ^ np.repeat(mix64(np.arange(1, len(starts) + 1, dtype=U64)), length)
    ordered = np.sort(tagged)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    inside = np.zeros(len(starts), bool)
    if len(twice):
        inside[np.searchsorted(starts, np.flatnonzero(np.isin(tagged, twice)), "right") - 1] = True
    return low[starts], _sequence(h, starts, length + WINDOW - 1), starts + base, length, inside


def _texts(batches, column: str):
    """``(slice, i, text, hashes of its words)`` of each row."""
    for part, texts in chunks(batches, column):
        if all(len(t) <= 1_000_000 for t in texts):
            w = Words(texts, _TABLE)
            for i, t in enumerate(texts):
                yield part, i, t, w.hash[w.first[i] : w.first[i + 1]]
        else:
            for i, t in enumerate(texts):
                yield part, i, t, np.concatenate([Words([p], _TABLE).hash for p in pieces(t)])


def _plain(text: str) -> bytes:
    """The words of a text joined by one space."""
    raw = text.encode("utf-8", "surrogatepass")
    return b" ".join(raw.split()) if len(raw) < 1_000_000 else _BLANKS.sub(b" ", raw).strip(b" ")


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate(values) if values else np.empty(0)
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


_PLACE = "d long, t long, nw int"
_PARTS = {"m": "array<long>", "s": "array<long>", "a": "array<int>", "w": "array<int>", "own": "array<boolean>"}


def _scan(docs: DataFrame) -> DataFrame:
    """A row a document with its word count, the digest of its words and its super-k-mers."""

    def run(batches):
        rows, held = [], 0

        def flush():
            cols = [pa.array(x, k) for x, k in zip(zip(*[r[:4] for r in rows]), (pa.int64(), pa.int64(), pa.int32(), pa.string()))]
            lists = [_lists([r[4][j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))]
            return pa.RecordBatch.from_arrays(cols + lists, names=["d", "t", "nw", "whole", *_PARTS])

        for part, i, text, h in _texts(batches, "text"):
            m, s, a, w, own = superkmers(h)
            rows.append((part.column("d")[i].as_py(), part.column("t")[i].as_py(), len(h), hashlib.sha256(_plain(text)).hexdigest(), (m.view(np.int64), s.view(np.int64), a, w, own)))
            held += len(m)
            if held > 100_000 or len(rows) >= 1000:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    return docs.select("d", "t", "text").mapInArrow(run, f"{_PLACE}, whole string, " + ", ".join(f"{n} {k}" for n, k in _PARTS.items()))


def _occurrences(scanned: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row for each super-k-mer whose minimiser the filter lets through."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ends = np.diff(part.column("m").offsets.to_numpy())
                flat = {n: part.column(n).flatten() for n in _PARTS}
                row = np.repeat(np.arange(part.num_rows), ends)
                keep = np.flatnonzero(may_hold(bits, flat["m"].to_numpy()))
                if len(keep):
                    cols = [part.column(n).take(pa.array(row[keep])) for n in ("d", "t", "nw")] + [flat[n].take(pa.array(keep)) for n in _PARTS]
                    yield pa.RecordBatch.from_arrays(cols, names=["d", "t", "nw", *_PARTS])

    return scanned.select("d", "t", "nw", *_PARTS).mapInArrow(run, f"{_PLACE}, m long, s long, a int, w int, own boolean")


def _identity() -> Column:
    """A hash of one occurrence of a super-k-mer: that of ``hash_longs``."""
    return F.xxhash64("s", "d", F.col("a").cast("long"))


def _strings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The occurrences of super-k-mers that the filter lets through, with their words as one string."""

    def run(batches):
        cols = [[] for _ in range(8)]
        held = 0

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["m", "s", "d", "t", "nw", "a", "w", "words"])

        for part, i, text, h in _texts(batches, "text"):
            m, s, a, w, _ = superkmers(h)
            d, t = part.column("d")[i].as_py(), part.column("t")[i].as_py()
            keep = np.flatnonzero(may_hold(bits, hash_longs(s.view(np.int64), np.full(len(s), d), a)))
            if not len(keep):
                continue
            plain = _plain(text)
            gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
            begin, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(plain))
            stop = a[keep] + w[keep] + WINDOW - 2
            words = [plain[x:y] for x, y in zip(begin[a[keep]].tolist(), end[stop].tolist())]
            for c, v in zip(cols, (m.view(np.int64)[keep].tolist(), s.view(np.int64)[keep].tolist(), [d] * len(keep), [t] * len(keep), [len(h)] * len(keep), a[keep].tolist(), w[keep].tolist(), words)):
                c.extend(v)
            held += sum(map(len, words))
            if held > SORTED:
                yield flush()
                for c in cols:
                    c.clear()
                held = 0
        if cols[0]:
            yield flush()

    return docs.select("d", "t", "text").mapInArrow(run, f"m long, s long, {_PLACE}, a int, w int, words binary")


def _ranked(strings: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of packed strings: a number for equal words, the string's index, the offset in it.

    Exact: words get numbers, and equal runs of 2, 4, 8, 16 and then ``WINDOW`` words get numbers by sorting pairs.
    """
    codes = pa.array(b" ".join(strings).split(b" "), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        pair = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        codes = np.unique(pair, return_inverse=True)[1]
        span += step
    string = np.repeat(np.arange(len(windows)), windows)
    start = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    return codes[start[string] + offset], string, offset


def _bucket(rows: list[tuple]) -> pa.RecordBatch:
    """Windows of whole buckets that occur before, as one bit a window for each string that has some."""
    d, t, nw, a, w = (np.array(x, np.int64) for x in zip(*[r[:5] for r in rows]))
    code, string, offset = _ranked([r[5] for r in rows], w)
    place = a[string] + offset
    order = np.lexsort((place, d[string], code))
    code, dd, place = code[order], d[string][order], place[order]
    new = np.concatenate([[True], code[1:] != code[:-1]])
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = np.zeros(len(order), bool)
    late[order] = (dd != dd[least]) | (place != place[least])
    ends = np.cumsum(w)
    some = np.flatnonzero(np.add.reduceat(late, ends - w) > 0)
    bits = [np.packbits(late[ends[i] - w[i] : ends[i]]).tobytes() for i in some.tolist()]
    cols = [pa.array(x[some], k) for x, k in ((d, pa.int64()), (t, pa.int64()), (nw, pa.int32()), (a, pa.int32()), (w, pa.int32()))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(bits, pa.binary())], names=["d", "t", "nw", "a", "w", "bits"])


_SPAN = f"{_PLACE}, a int, w int, bits binary"


def _sorted_buckets(strings: DataFrame) -> DataFrame:
    """Repeated windows of buckets that one worker can sort. Rows come with equal minimisers together."""

    def run(batches):
        rows, now, held = [], None, 0
        for batch in batches:
            for m, *row in zip(*[batch.column(c).to_pylist() for c in ("m", "d", "t", "nw", "a", "w", "words")]):
                if m != now and held > SORTED:
                    yield _bucket(rows)
                    rows, held = [], 0
                now = m
                rows.append(row)
                held += len(row[5])
        if rows:
            yield _bucket(rows)

    dealt = strings.select("m", "d", "t", "nw", "a", "w", "words").repartition("m").sortWithinPartitions("m")
    return dealt.mapInArrow(run, _SPAN)


def _split_buckets(strings: DataFrame) -> DataFrame:
    """The same for larger buckets: each window goes by two hashes of its words, the least place is combined before the shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                w = part.column("w").to_numpy().astype(np.int64)
                h = Words([b" ".join(part.column("words").to_pylist()).decode("utf-8", "surrogatepass")], _TABLE).hash
                string = np.repeat(np.arange(len(w)), w)
                first = np.cumsum(w + WINDOW - 1) - (w + WINDOW - 1)
                offset = np.arange(len(string)) - np.repeat(np.cumsum(w) - w, w)
                at_word = first[string] + offset
                x = _sequence(h, at_word, np.full(len(string), WINDOW))
                y = _sequence(mix64(h), at_word, np.full(len(string), WINDOW))
                cols = [part.column(c).take(pa.array(string)) for c in ("d", "t", "nw", "a", "w")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(offset, pa.int32()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["d", "t", "nw", "a", "w", "o", "x", "y"])

    each = cut(strings.select("d", "t", "nw", "a", "w", "words").mapInArrow(run, "d long, t long, nw int, a int, w int, o int, x long, y long"))
    least = cut(each.groupBy("x", "y").agg(F.min(F.struct("d", (F.col("a") + F.col("o")).alias("p"))).alias("least"), F.count("*").alias("k")).where("k > 1").select("x", "y", "least"))
    late = each.join(least, ["x", "y"]).where("d <> least.d or a + o <> least.p")
    return late.select("d", "t", "nw", (F.col("a") + F.col("o")).alias("a"), F.lit(1).alias("w"), F.lit(None).cast("binary").alias("bits"))


def _covered(spans: DataFrame) -> DataFrame:
    """``d, t, nw, removed, keep``: words of a document that repeats cover, and one bit a word that stays (null: none stays)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                removed, keep = [], []
                for nw, spans in zip(part.column("nw").to_pylist(), part.column("spans")):
                    edge = np.zeros(nw + 1, np.int32)
                    found = spans.values
                    a, w = (found.field(n).to_numpy().astype(np.int64) for n in ("a", "w"))
                    bits = found.field("bits")
                    whole = bits.is_null().to_numpy(zero_copy_only=False)
                    np.add.at(edge, a[whole], 1)
                    np.add.at(edge, (a + w + WINDOW - 1)[whole], -1)
                    for i in np.flatnonzero(~whole).tolist():
                        late = a[i] + np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), count=w[i]))
                        np.add.at(edge, late, 1)
                        np.add.at(edge, late + WINDOW, -1)
                    gone = np.cumsum(edge)[:nw] > 0
                    removed.append(int(gone.sum()))
                    keep.append(None if gone.all() else np.packbits(~gone).tobytes())
                cols = [part.column("d"), part.column("t"), part.column("nw"), pa.array(removed, pa.int64()), pa.array(keep, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "t", "nw", "removed", "keep"])

    by = spans.groupBy("d", "t").agg(F.max("nw").alias("nw"), F.collect_list(F.struct("a", "w", "bits")).alias("spans"))  # no more than a document has
    return by.select("d", "t", "nw", "spans").mapInArrow(run, f"{_PLACE}, removed long, keep binary")


def _texts_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose hash ``k`` the filter lets through."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits, batch.column("k").to_numpy())))

    return docs.select("d", "t", "k", "text").mapInArrow(run, "d long, t long, k long, text string")


def _kept(masked: DataFrame) -> DataFrame:
    """``d, t, text``: the words that the bits in ``keep`` leave, joined by one space."""

    def run(batches):
        for part, texts in chunks(batches, "text"):
            out = []
            for text, keep, nw in zip(texts, part.column("keep").to_pylist(), part.column("nw").to_pylist()):
                left = np.unpackbits(np.frombuffer(keep, np.uint8), count=nw).astype(bool)
                plain = _plain(text)
                gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
                begin, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(plain))
                edge = np.diff(left.astype(np.int8), prepend=0, append=0)
                runs = zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())
                out.append(b" ".join([plain[begin[x] : end[y]] for x, y in runs]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), pa.array(out)], names=["d", "t", "kept"])

    return masked.select("d", "t", "nw", "keep", "text").mapInArrow(run, "d long, t long, kept string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words that no repeated window covers, joined by one space;
    with ``digest`` its SHA-256 as ``kept_sha256`` instead.

    Words are runs of anything but ASCII white space, unchanged. A window of ``WINDOW`` words is a repeat
    if its words also stand at a smaller ``(key, first word)``; all windows are judged on the texts as given.
    Keys of other types than whole numbers count by their order. Rows without a key count as one last
    document. Repeated rows have the same places, so none is a repeat of the other and all get the same
    result, and two texts of one key are judged by where their words stand. Null and empty texts
    have no words; texts of fewer words than a window lose none; a text of any length is looked at in parts. An empty table
    gives an empty result. Columns named as the made ones are replaced, all others kept. The whole texts
    are sent through a shuffle only where some but not all of their words go.
    """
    made = ["n_words", "n_removed", "kept_sha256" if digest else "kept"]
    kept = [c for c in docs.columns if c not in made or c in (key, text)]
    return aside(docs, (key, text), made, lambda d: _remove(d, key, text, digest)).select(*kept, *[c for c in made if c not in kept])


def _remove(docs: DataFrame, key: str, text: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession

    def step(df: DataFrame) -> DataFrame:
        path = scratch(spark)
        df.write.option("compression", "zstd").parquet(path)
        release(spark)
        return spark.read.parquet(path)

    if isinstance(docs.schema[key].dataType, IntegralType):
        placed = docs.withColumn("d", F.coalesce(F.col(key).cast("long"), F.lit(LAST)))
    else:
        order = global_rank(docs.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], "d")
        placed = docs.join(step(order), key, "left").withColumn("d", F.coalesce("d", F.lit(LAST)))
    placed = placed.withColumn("t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    source = placed.select("d", "t", F.col(text).alias("text"))
    scanned = step(_scan(source))
    # minimisers that occur again, or have equal windows inside one super-k-mer
    pairs = F.explode(F.arrays_zip("m", "own")).alias("x")
    again = cut(scanned.select(pairs).groupBy(F.col("x.m").alias("m")).agg(F.count("*").alias("k"), F.max("x.own").alias("own")).where("k > 1 or own").select("m"))
    places = step(_occurrences(scanned, bloom(again, "m", again.count())))
    strings = cut(places.groupBy("m", "s").agg(F.min(F.struct("d", "a")).alias("first"), F.count("*").alias("k"), F.max("own").alias("own")))
    release(spark)
    # what occurs again as a whole
    whole = strings.where("k > 1").select("m", "s", F.col("first.d").alias("d0"), F.col("first.a").alias("a0"))
    late = places.join(whole, ["m", "s"]).where("d <> d0 or a <> a0").select("d", "t", "nw", "a", "w", F.lit(None).cast("binary").alias("bits"))
    # what meets others in the bucket of its minimiser
    size = strings.groupBy("m").agg(F.count("*").alias("c"), F.max("own").alias("any")).where("c > 1 or any").select("m", "c")
    travel = cut(strings.join(size, "m").where("c > 1 or own").select("s", F.col("first.d").alias("d"), F.col("first.a").alias("a"), "c"))
    packed = _strings(source, bloom(travel.select(_identity().alias("h")), "h", travel.count()))
    packed = step(packed.join(travel, ["s", "d", "a"]))
    spans = step(late.unionByName(_sorted_buckets(packed.where(F.col("c") <= HOT))).unionByName(_split_buckets(packed.where(F.col("c") > HOT))))
    covered = step(_covered(spans))
    some = covered.where("keep is not null")
    wanted = cut(some.select(F.xxhash64("d", "t").alias("k")))
    texts = _texts_of(source.withColumn("k", F.xxhash64("d", "t")), bloom(wanted, "k", wanted.count())).drop("k")
    left = _kept(texts.join(some, ["d", "t"]))
    if digest:
        left = step(left.select("d", "t", F.sha2("kept", 256).alias("kept")).dropDuplicates(["d", "t"]))
        facts = scanned.select("d", "t", F.col("nw").cast("long").alias("n_words"), "whole").dropDuplicates(["d", "t"])
    else:
        left = step(left.dropDuplicates(["d", "t"]))
        facts = scanned.select("d", "t", F.col("nw").cast("long").alias("n_words")).dropDuplicates(["d", "t"])
    facts = facts.join(covered.drop("nw", "keep"), ["d", "t"], "left").join(left, ["d", "t"], "left")
    facts = facts.withColumn("n_removed", F.coalesce("removed", F.lit(0).cast("long")))
    if digest:
        rest = F.when(F.col("n_removed") == 0, F.col("whole")).otherwise(F.lit(_EMPTY))
        return placed.join(facts.withColumn("kept_sha256", F.coalesce("kept", rest)).select("d", "t", "n_words", "n_removed", "kept_sha256"), ["d", "t"])
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "), "^ | $", ""))
    out = placed.join(facts.select("d", "t", "n_words", "n_removed", F.col("kept").alias("_left")), ["d", "t"])
    return out.withColumn("kept", F.coalesce("_left", F.when(F.col("n_removed") == 0, plain).otherwise(F.lit(""))))


def op11_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
