"""Alignment of two tokenizers' tokens by byte ranges, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes. ``pandas.merge_asof`` over a batch, keyed by document, finds for
each token start the other side's token that covers it; both directions together are all overlaps. Where
tokens of both sides end, a group ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import aside, chunks
from tidemark.session import cut, release, scratch, table

#: Characters aligned at once, and of a part of a very long text, which is encoded part by part.
SLICE, LONG = 200_000, 1_000_000
#: Cached words in a worker.
CACHE = 1 << 18
#: Commonest pairs whose counts every task holds (16 MB at most); the others are joined.
HELD = 1 << 20
#: A link's code is A's id times this, plus B's id.
SHIFT = 15
_BETWEEN = re.compile("[A-Za-z](?= [A-Za-z])")
#: Where words may not stand alone: white space beside a space, or at an end of the text.
_ODD = re.compile(r" \s|\s |^\s|\s$|\s\Z")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by
    their order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coders:
    """Both sides. Side A: byte-level BPE by the vocabulary of a ``tokenizers`` file, whose ids are the merges' ranks. Side B: a
    SentencePiece model, which puts a space before a text.

    A space after another character begins a token on both sides: no piece of B has a space after its start, and A's
    pattern joins a space to what follows. So words between spaces are encoded, and cached, one by one; a
    text in which spaces meet other white space is encoded whole. The caches map a word to each side's packed ids, or to
    None if either side does not give the word back.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.cache: tuple[dict, dict] = {}, {}
        with open(a_path or default_path("byte_bpe_50k.json"), encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        char = _byte_of_char()
        ranks = {bytes(char[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or default_path("piece_bpe_32k.model"))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(ranks.values()) >= 1 << 16 or len(pieces) > 1 << SHIFT or any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("vocabularies too large, or a piece with a space after its start")
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.tokens = tokens, [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.length = [np.array([len(t) for t in side], np.int64) for side in self.tokens]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and a text on both sides, if both give it back."""
        both = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        want = (" " + text).encode()
        if any(b"".join(map(tokens.__getitem__, x)) != want for tokens, x in zip(self.tokens, both)):
            return None
        return tuple(np.array(x, np.uint16) for x in both)

    def _learn(self, words: list[str]) -> None:
        """Puts words into the caches: encoded as one text and cut where words begin, or one by one if that is not given back."""
        found = self._whole(" ".join(words))
        if found is None:
            for w in words:
                for side, x in zip(self.cache, self._whole(w) or (None, None)):
                    side[w] = None if x is None else x.tobytes()
            return
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        for side, x, length in zip(self.cache, found, self.length):
            stop = (np.searchsorted(np.cumsum(length[x]), ends) + 1).tolist()
            packed = x.tobytes()
            side.update(zip(words, [packed[2 * i : 2 * j] for i, j in zip([0, *stop], stop)]))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if either does not give back a space and the text."""
        if _ODD.search(text):
            found = self._whole(text)
            return found and tuple(x.astype(np.int64) for x in found)
        words = text.split(" ")
        new = [w for w in dict.fromkeys(words) if w not in self.cache[0]]
        if len(self.cache[0]) + len(new) > CACHE:
            new = list(dict.fromkeys(words))
            for side in self.cache:
                side.clear()
        if new:
            self._learn(new)
        found = [list(map(side.__getitem__, words)) for side in self.cache]
        if None in found[0]:
            return None
        return tuple(np.frombuffer(b"".join(f), np.uint16).astype(np.int64) for f in found)


@lru_cache(2)
def coders(a_path: str, b_path: str) -> Coders:
    return Coders(a_path, b_path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _numbers() -> list[str]:
    """Decimal numbers with what may follow them in the text of groups."""
    return [f"{i}{end}" for i in range(1 << 16) for end in ("", ",", "|", ";")]


def align(texts: list[str], both: Coders) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Tokens of both sides (``doc, start, id, end``; places over the whole batch) and links (``doc, ia, ib``: indices of
    overlapping tokens)."""
    docs, ids = [], ([], [])
    for doc, text in enumerate(texts):
        try:
            found = both.encode(text) if text else None
        except UnicodeError:  # half a surrogate pair
            found = None
        if found:
            docs.append(doc)
            for side, x in zip(ids, found):
                side.append(x)
    frames = []
    for side, length in zip(ids, both.length):
        token = np.concatenate([*side, np.empty(0, np.int64)])
        end = np.cumsum(length[token])
        frames.append(pd.DataFrame({"doc": np.repeat(docs, [len(x) for x in side]).astype(np.int64), "start": end - length[token], "id": token, "end": end}))
    a, b = frames
    left = pd.DataFrame({"doc": a.doc, "start": a.start, "ia": np.arange(len(a))})
    right = pd.DataFrame({"doc": b.doc, "start": b.start, "ib": np.arange(len(b))})
    covering_b = pd.merge_asof(left, right, on="start", by="doc")
    covering_a = pd.merge_asof(right, left, on="start", by="doc")
    # where both start, both directions have found the same pair
    covering_a = covering_a[a.start.to_numpy()[covering_a.ia.to_numpy(np.int64)] != covering_a.start.to_numpy()]
    return a, b, pd.concat([covering_b[["doc", "ia", "ib"]], covering_a[["doc", "ia", "ib"]]]).astype(np.int64)


def groups(a: pd.DataFrame, b: pd.DataFrame, number: int) -> tuple[np.ndarray, list[str]]:
    """Groups of each document: how many, and their text ``a1,a2|b1;a3|b2,b3``."""
    na, nb = len(a), len(b)
    if not na:
        return np.zeros(number, np.int64), [""] * number
    ends = [f.end.to_numpy() for f in (a, b)]
    size = int(ends[0][-1]) + 1
    marks = [np.zeros(size, np.int32) for _ in ends]
    for mark, e in zip(marks, ends):
        mark[e] = 1
    cut = marks[0] & marks[1]
    before = np.cumsum(cut) - cut  # groups that end before a place
    group = [before[e] for e in ends]
    sizes = [np.bincount(g) for g in group]
    at = np.empty(na + nb, np.int64)
    at[:na] = np.arange(na) + (np.cumsum(sizes[1]) - sizes[1])[group[0]]
    at[na:] = np.arange(nb) + np.cumsum(sizes[0])[group[1]]
    merged = np.empty((4, na + nb), np.int64)
    for row, x in zip(merged, (np.concatenate(group), np.repeat([0, 1], [na, nb]), *(np.concatenate([a[c].to_numpy(), b[c].to_numpy()]) for c in ("doc", "id")))):
        row[at] = x
    where, side, doc, token = merged
    after = np.zeros(na + nb, np.int64)
    same = where[1:] == where[:-1]
    after[:-1] = np.where(same & (side[1:] == side[:-1]), 1, np.where(same, 2, np.where(doc[1:] == doc[:-1], 3, 0)))
    bounds = np.searchsorted(doc, np.arange(number + 1)).tolist()
    texts = list(map(_numbers().__getitem__, (token * 4 + after).tolist()))
    first = np.concatenate([[True], ~same])
    return np.bincount(doc[first], minlength=number), ["".join(texts[x:y]) for x, y in zip(bounds, bounds[1:])]


def _facts(texts: list[str], both: Coders) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
    """Of each text: numbers of A's and B's tokens, groups and links; the groups' text; the links' sorted codes."""
    n = len(texts)
    a, b, links = align(texts, both)
    n_groups, named = groups(a, b, n)
    code = (a.id.to_numpy()[links.ia] << SHIFT) | b.id.to_numpy()[links.ib]
    code = np.sort(code | (links.doc.to_numpy() << 32)) & 0xFFFFFFFF
    count = np.bincount(links.doc, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(count)]).tolist()
    return [np.bincount(a.doc, minlength=n), np.bincount(b.doc, minlength=n), n_groups, count], named, [code[x:y] for x, y in zip(bounds, bounds[1:])]


def parts(text: str) -> list[str]:
    """A very long text in parts: cut at a space between letters, where a token begins on both sides; each part is a text of
    its own then, as a space stands before it."""
    out, at = [], 0
    while len(text) - at > LONG and (m := _BETWEEN.search(text, at + LONG)):
        out.append(text[at : m.end()])
        at = m.end() + 1
    return [*out, text[at:]]


def _long_facts(text: str, both: Coders, whole: bool):
    """The same for a very long text, and the digest of its groups."""
    digest, total, named, codes = hashlib.sha256(), np.zeros(4, np.int64), [], []
    for part in parts(text):
        facts, (group,), (code,) = _facts([part], both)
        if not facts[0][0]:  # a part that is not given back
            return [np.zeros(1, np.int64)] * 4, "", "", np.empty(0, np.int64)
        digest.update((";" if codes else "").encode() + group.encode())
        total += np.concatenate(facts)
        codes.append(code)
        named += [group] if whole else []
    return list(total[:, None]), digest.hexdigest(), ";".join(named), np.sort(np.concatenate(codes))


_FACTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long"}


def _aligned(docs: DataFrame, text: str, paths: tuple[str, str], whole: bool) -> DataFrame:
    """``docs`` without its text, with its counts, the digest (or, if ``whole``, the text) of its groups and ``links``: its links' codes in
    order, as differences of 32 bits, which compress well."""
    rest = docs.drop(text)
    names = rest.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema) + ", ".join(f"{n} {k}" for n, k in _FACTS.items()) + ", groups string, links binary"

    def run(batches):
        both = coders(*paths)
        for part, texts in chunks(batches, text, SLICE, 128):
            if len(texts) == 1 and len(texts[0]) > LONG:
                facts, digest, group, code = _long_facts(texts[0], both, whole)
                named, codes = [group if whole else digest], [code]
            else:
                facts, named, codes = _facts(texts, both)
                named = named if whole else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in named]
            packed = [np.diff(c, prepend=0).astype(np.int32).tobytes() for c in codes]
            cols = [part.column(c) for c in names] + [pa.array(f, pa.int64()) for f in facts] + [pa.array(named, pa.string()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *_FACTS, "groups", "links"])

    return docs.mapInArrow(run, schema)


def _codes(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All links' codes, and how many each row has."""
    each = [np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64) for x in packed]
    return np.concatenate([*each, np.empty(0, np.int64)]), np.array([len(x) for x in each], np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(code, links)``: how many links of the corpus join the two ids. Tasks send each pair once a million links or so."""

    def run(batches):
        held, size = [], 0

        def flush():
            code, number = (np.concatenate(x) for x in zip(*held))
            code, at = np.unique(code, return_inverse=True)
            return code, np.bincount(at, number).astype(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                codes, _ = _codes(batch.column("links").slice(at, 128).to_pylist())
                held.append(np.unique(codes, return_counts=True))
                size += len(held[-1][0])
                if size > 4 * HELD:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > 2 * HELD:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["code", "links"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, flush())), names=["code", "links"])

    return aligned.select("links").mapInArrow(run, "code long, links long").groupBy("code").agg(F.sum("links").alias("links"))


def _scored(aligned: DataFrame, common: tuple[np.ndarray, np.ndarray], best: np.ndarray) -> DataFrame:
    """``row, n_best, count_sum`` over the links of common pairs, and ``rare``: other pairs with their number of links."""
    codes, counts = common

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                code, number = _codes(part.column("links").to_pylist())
                row = np.repeat(np.arange(part.num_rows), number)
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                known = codes[place] == code
                count = np.where(known, counts[place], 0)
                top = known & (count == best[code & ((1 << SHIFT) - 1)])
                ends = np.concatenate([[0], np.cumsum(number)])
                running = np.concatenate([[0], np.cumsum(count)])
                total = running[ends[1:]] - running[ends[:-1]]
                lost = np.flatnonzero(~known)
                pair, times = np.unique(np.stack([row[lost], code[lost]]), axis=1, return_counts=True) if len(lost) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
                offset = np.searchsorted(pair[0], np.arange(part.num_rows + 1))
                rare = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.StructArray.from_arrays([pa.array(pair[1]), pa.array(times)], names=["code", "times"]))
                cols = [part.column("row"), pa.array(np.bincount(row, top, part.num_rows).astype(np.int64)), pa.array(total), rare]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "n_best", "count_sum", "rare"])

    return aligned.select("row", "links").mapInArrow(run, "row long, n_best long, count_sum long, rare array<struct<code:long,times:long>>")


def cross_align(docs: DataFrame, text: str = "text", a_path: str = "", b_path: str = "", whole: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` (with its text, unless ``keep_text`` is false) with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256`` (with ``whole``: ``groups``, the text itself).

    A encodes a space and the text by a byte-level vocabulary, B the text, before which it puts a space
    itself; strings of special tokens are plain text. Tokens whose bytes overlap are linked, and
    ``count_sum`` adds up, over a document's links, how many links of all documents join the same two ids;
    ``n_best`` counts links whose two ids are joined as often as B's id is with any. Null and empty texts, and
    those that either side does not give back byte by byte, have no tokens: zeros and an empty string. Repeated rows count each.
    An empty table gives an empty result; columns named as the made ones are replaced, all others kept. A text beyond ``LONG``
    characters is encoded in parts, cut before a space between two letters; one that has none goes whole.
    Tasks hold the counts of the ``HELD`` commonest pairs and of each B id's best; all other pairs are joined.
    The files must be at their paths on every machine; without a path each worker looks up the public file.
    """
    last = "groups" if whole else "groups_sha256"
    made = [*_FACTS, "n_best", "count_sum", last]
    kept = [c for c in docs.columns if c != text and c not in made or c == text and keep_text]
    return aside(docs, (text,), made, lambda d: _cross(d, text, (a_path, b_path), whole, keep_text)).select(*kept, *[c for c in made if c not in kept])


def _cross(docs: DataFrame, text: str, paths: tuple[str, str], whole: bool, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    keep = [c for c in docs.columns if keep_text or c != text]
    path = scratch(spark)
    narrow = docs.select(*keep, F.col(text).alias("_t"))
    _aligned(narrow, "_t", paths, whole).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    counts = cut(pair_counts(aligned))
    release(spark)
    best = np.zeros(1 << SHIFT, np.int64)
    of_b = counts.groupBy(F.expr(f"code & {(1 << SHIFT) - 1}").alias("b")).agg(F.max("links").alias("links")).toArrow()  # one row an id of B
    best[of_b.column("b").to_numpy()] = of_b.column("links").to_numpy()
    top = counts.orderBy(F.desc("links"), "code").limit(HELD).toArrow()
    order = np.argsort(top.column("code").to_numpy())
    common = (np.append(top.column("code").to_numpy()[order], -1 << 40), np.append(top.column("links").to_numpy()[order], 0))
    common = (np.roll(common[0], 1), np.roll(common[1], 1))
    path = scratch(spark)
    _scored(aligned, common, best).write.option("compression", "zstd").parquet(path)
    scored = spark.read.parquet(path)
    each = scored.select("row", F.explode("rare").alias("x")).select("row", "x.code", "x.times")
    highest = spark.createDataFrame(pd.DataFrame({"b": np.arange(len(best)), "high": best}))
    known = cut(counts.withColumn("b", F.expr(f"code & {(1 << SHIFT) - 1}")).join(F.broadcast(highest), "b").select("code", "links", "high"))
    rare = each.join(known, "code").groupBy("row").agg(F.sum(F.col("links") * F.col("times")).alias("more"), F.sum(F.when(F.col("links") == F.col("high"), F.col("times")).otherwise(0)).alias("best"))
    total = scored.drop("rare").join(rare, "row", "left")
    total = total.select("row", (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))
    out = aligned.drop("links").join(total, "row").withColumn("_g", F.col("groups"))
    return out.select(*keep, *_FACTS, "n_best", "count_sum", F.col("_g").alias("groups" if whole else "groups_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cross_align(docs, keep_text=False)
