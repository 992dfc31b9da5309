"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks of documents of like size. A document's Bloom signature holds, for each of its terms, one entry
for every step of ``STEPS`` that the term's frequency reaches. A block's signatures are stored by bit: slice ``i`` is the
bitmap of the documents that have bit ``i``. The slices of an entry, and-ed, mark all documents that
have the term so often, and a few that do not: an overestimate. Sums of these bitmaps, weighted by the
terms and by what a frequency up to the next step adds to a score, bound each document's score from above.

A search goes through the blocks and rescores exactly every document whose bound reaches the score of the
``k``-th best so far in its task, which no final result can stay below.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.filters import bloom, may_hold
from tidemark.llm.batches import U64, Words, chunks, lower_table, mix64, pieces
from tidemark.session import cut, release, scratch, table, written

#: Frequencies at which a term gets one more entry in the signature.
STEPS = [1, 2, 3, 4, *[x << s for s in range(1, 22) for x in (3, 4)]]
#: Slices of an entry; bits to an entry, at least; widths of signatures.
HASHES, BITS, NARROW, WIDE = 3, 8, 256, 1 << 21
#: Documents, characters and signature bits of a block, at most (one document has a block to itself otherwise).
ROWS, CHARS, CELLS = 256, 500_000, 1 << 24
#: Items' terms that one pass over the index answers, about, and terms whose bitmaps are held at once.
TERMS, HELD = 1 << 17, 4_096
#: Distinct terms whose document counts a task holds before it sends them.
COUNTED = 1 << 20

_TABLE = lower_table("alnum")
_LEVEL = mix64(np.arange(1, len(STEPS) + 1, dtype=U64))
_AT = np.array(STEPS)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct terms of a text, and how often each occurs."""
    h = np.concatenate([Words([p], _TABLE).hash for p in pieces(text)])
    return _counted(h)


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.diff(first, append=len(h))


def entries(h: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The signature entries of a document's terms."""
    levels = np.searchsorted(_AT, tf, "right")
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    return mix64(np.repeat(h, levels) ^ _LEVEL[level])


def bits(entry: np.ndarray, width: int) -> np.ndarray:
    """The places of an entry in a signature of so many bits: one row for each of its slices."""
    return np.stack([((entry >> U64(21 * k)) & U64(width - 1)).astype(np.int64) for k in range(HASHES)])


def width_for(n: int) -> int:
    return min(WIDE, max(NARROW, 1 << (BITS * n - 1).bit_length()))


def _block(width: int, rows: list) -> dict:
    """The slices of a block's documents, end to end; a slice has a whole number of bytes."""
    cells = np.zeros((width, -(-len(rows) // 8) * 8), bool)
    for i, (_, _, entry, _) in enumerate(rows):
        cells[bits(entry, width), i] = True
    return {"width": width, "ids": [r[0] for r in rows], "n": [r[1] for r in rows], "texts": [r[3] for r in rows], "slices": np.packbits(cells, axis=1).tobytes()}


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents with a term, as a written table.

    Rows with ``width`` are blocks: ``ids``, numbers of terms ``n``, ``texts`` and ``slices``. The others hold, for a
    part of the documents, packed hashes of terms (``terms``) and how many of them have each (``counts``).
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        open_blocks: dict[int, list] = {}
        size: dict[int, int] = {}
        seen, held = [], 0
        keys = None

        def batch(blocks=(), term=None):
            rows = list(blocks)
            cols = [
                pa.array([r["width"] for r in rows] + [None] * (term is not None), pa.int32()), pa.array([r["ids"] for r in rows] + [None] * (term is not None), pa.list_(keys)),
                pa.array([r["n"] for r in rows] + [None] * (term is not None), pa.list_(pa.int64())), pa.array([r["texts"] for r in rows] + [None] * (term is not None), pa.list_(pa.string())),
                pa.array([r["slices"] for r in rows] + [None] * (term is not None), pa.binary()), pa.array([None] * len(rows) + ([term[0].tobytes()] if term else []), pa.binary()), pa.array([None] * len(rows) + ([term[1].astype(np.int64).tobytes()] if term else []), pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["width", "ids", "n", "texts", "slices", "terms", "counts"])

        for part, texts in chunks(batches, text):
            keys = part.schema.field(key).type
            for i, t in enumerate(texts):
                h, tf = terms(t)
                if not len(h):
                    continue
                seen.append(h)
                held += len(h)
                e = entries(h, tf)
                w = width_for(len(e))
                rows = open_blocks.setdefault(w, [])
                if rows and (len(rows) >= min(ROWS, CELLS // w) or size[w] + len(t) > CHARS):
                    yield batch([_block(w, rows)])
                    rows = open_blocks[w] = []
                if not rows:
                    size[w] = 0
                rows.append((part.column(key)[i].as_py(), int(tf.sum()), e, t))
                size[w] += len(t)
            if held > 4 * COUNTED:
                yield batch(term=_counted(np.concatenate(seen)))
                seen, held = [], 0
        for w, rows in open_blocks.items():
            if rows:
                yield batch([_block(w, rows)])
        if seen:
            yield batch(term=_counted(np.concatenate(seen)))

    made = docs.select(key, text).mapInArrow(run, f"width int, ids array<{kind}>, n array<long>, texts array<string>, slices binary, terms binary, counts binary")
    path = scratch(docs.sparkSession)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def document_counts(indexed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``(term, df)`` of the terms that the filter lets through."""

    def run(batches):
        for batch in batches:
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                h = np.frombuffer(t, U64)
                keep = may_hold(wanted, h)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(np.frombuffer(c, np.int64)[keep])], names=["term", "df"])

    parts = indexed.where("terms is not null").select("terms", "counts").mapInArrow(run, "term long, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


class Query:
    """Some items, ready to be scored: their distinct terms, and each item's terms with their weights."""

    def __init__(self, items: list[int], term: list[np.ndarray], weight: list[np.ndarray]):
        self.items = items
        self.terms = np.unique(np.concatenate(term))
        self.at = [np.searchsorted(self.terms, t) for t in term]
        self.weight = weight

    def present(self, slices: np.ndarray) -> list[np.ndarray]:
        """For each step of frequency, documents that may have each term so often."""
        width, out = len(slices), []
        for level in _LEVEL:
            p = bits(mix64(self.terms ^ level), width)
            found = slices[p[0]]
            for row in p[1:]:
                found = found & slices[row]
            if out:
                found &= out[-1]
            if not found.any():
                break
            out.append(found)
        return out


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def bounds(query: Query, present: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """No document's score for an item is above this: ``[item, document]``."""
    out = np.zeros((len(query.items), len(n)))
    before = np.zeros(len(n), np.int64)
    for step, bitmaps in enumerate(present):
        most = STEPS[step + 1] - 1 if step + 1 < len(STEPS) else (1 << 40)
        now = gain(np.minimum(most, n), m)
        held = np.unpackbits(bitmaps, axis=1, count=len(n)).astype(np.float64)
        for i, (at, weight) in enumerate(zip(query.at, query.weight)):
            out[i] += (weight @ held[at]) * (now - before)
        before = now
    return out


def _order(found: tuple) -> tuple:
    score, key = found
    return -score, key is None, key


class Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items)  # a score below which nothing counts

    def add(self, i: int, scores: np.ndarray, keys: list) -> None:
        new = [(s, keys[j]) for j, s in enumerate(scores.tolist()) if s >= self.least[i]]
        if new:
            self.held[i] = sorted(self.held[i] + new, key=_order)[: self.k]
            if len(self.held[i]) == self.k:
                self.least[i] = self.held[i][-1][0]


def score_block(query: Query, best: Best, ids: list, n: np.ndarray, texts: list[str], slices: np.ndarray, all_docs: int, all_terms: int) -> int:
    """Rescores exactly all documents of a block that their bounds do not exclude; returns how many."""
    m = 75 + (25 * n * all_docs) // all_terms
    upper = bounds(query, query.present(slices), n, m)
    open_ = upper >= best.least[:, None]
    docs = np.flatnonzero(open_.any(axis=0))
    if not len(docs):
        return 0
    tf = np.zeros((len(query.terms), len(docs)), np.int64)
    for j, d in enumerate(docs.tolist()):
        h, count = terms(texts[d])
        at = np.minimum(np.searchsorted(h, query.terms), len(h) - 1)
        tf[:, j] = np.where(h[at] == query.terms, count[at], 0)
    value = gain(tf, m[docs])
    for i in np.flatnonzero(open_.any(axis=1)).tolist():
        mine = np.flatnonzero(open_[i, docs])
        scores = query.weight[i].astype(np.int64) @ value[np.ix_(query.at[i], mine)]
        best.add(i, scores, [ids[d] for d in docs[mine].tolist()])
    return len(docs)


def _pass(indexed: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], all_docs: int, all_terms: int, k: int) -> DataFrame:
    """``(item, key, score)``: each task's best documents for each of the asked items."""
    kind = indexed.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        queries, now, size = [], [], 0
        for x in asked:
            if now and size + len(x[1]) > HELD:
                queries.append(Query(*map(list, zip(*now))))
                now, size = [], 0
            now.append(x)
            size += len(x[1])
        queries.append(Query(*map(list, zip(*now))))
        best = [Best(len(q.items), k) for q in queries]
        keys = None
        for batch in batches:
            keys = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids, n = batch.column("ids")[r].as_py(), np.array(batch.column("n")[r].as_py(), np.int64)
                slices = np.frombuffer(batch.column("slices")[r].as_py(), np.uint8).reshape(batch.column("width")[r].as_py(), -1)
                texts = batch.column("texts")[r].as_py()
                for q, b in zip(queries, best):
                    score_block(q, b, ids, n, texts, slices, all_docs, all_terms)
        rows = [(item, key, score) for q, b in zip(queries, best) for item, held in zip(q.items, b.held) for score, key in held]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], keys), pa.array(cols[2], pa.int64())], names=["item", "found", "score"])

    blocks = indexed.where("width is not null").select("width", "ids", "n", "texts", "slices")
    return blocks.mapInArrow(run, f"item long, found {kind}, score long")


def _asked(items: DataFrame, text: str) -> DataFrame:
    """``(item, term, q)``: the distinct terms of each item."""

    def run(batches):
        for part, texts in chunks(batches, text):
            each = [terms(t) for t in texts]
            item = np.repeat(part.column("item").to_numpy(), [len(h) for h, _ in each])
            h, q = (np.concatenate(x) for x in zip(*each))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(h.view(np.int64)), pa.array(q.astype(np.int64))], names=["item", "term", "q"])

    return items.select("item", text).mapInArrow(run, "item long, term long, q long")


def search(indexed: DataFrame, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(item, rank, key, score)``: each item's ``k`` highest scores above 0 among all documents of the index, equal ones by key (null last).

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased; weights and scores are whole numbers.
    Items of one id and text are answered once, items of one id and different texts each; null and empty texts find nothing; an
    empty table of items or documents gives an empty result. Repeated documents stand each for themselves; documents without terms are
    not found and not counted. Texts of any length are looked at in parts. Items go in passes of about ``TERMS`` terms; a task holds the
    ``k`` best of each item of a pass, and its ``k``-th best bounds what it must still rescore. Terms are told apart by 64-bit hashes.
    """
    spark = indexed.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # a block is a row of about a megabyte
    size = indexed.where("width is not null").select(F.size("ids").alias("docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    all_docs, all_terms = size.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    named = written(items.select(F.col(item).alias("id"), F.col(text).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()))
    asked = written(_asked(named, "text"))
    wanted = asked.select("term").distinct()
    df = document_counts(indexed, bloom(wanted, "term", wanted.count()))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * all_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = cut(asked.join(df, "term").withColumn("w", weight * F.col("q")).where("w > 0"))
    release(spark)
    passes = max(1, -(-weighted.count() // TERMS))
    found = None
    for number in range(passes):
        mine = weighted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).orderBy("item", "term").toArrow()
        if not mine.num_rows:
            continue
        which = mine.column("item").to_numpy()
        term, w = mine.column("term").to_numpy().view(U64), mine.column("w").to_numpy().astype(np.float64)
        cuts = np.flatnonzero(np.diff(which)) + 1
        one = _pass(indexed, list(zip(which[np.concatenate([[0], cuts])].tolist(), np.split(term, cuts), np.split(w, cuts))), all_docs, all_terms, k)
        one = one if passes == 1 else cut(one)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], f"item long, found {indexed.schema['ids'].dataType.elementType.simpleString()}, score long")
    over = Window.partitionBy("item").orderBy(F.desc("score"), F.col("found").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return top.join(named.select("item", "id"), "item").select(F.col("id").alias(item), "rank", F.col("found").alias(key), "score")


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(index(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
with t as (select doc_id, unnest({_TERMS}) term from documents),
tf as (select doc_id, term, count(*) tf from t group by all),
n as (select doc_id, count(*) n from t group by all),
total as (select count(*) docs, sum(n)::bigint terms from n),
df as (select term, count(*) df from tf group by all),
q as (select item_id, term, count(*) q from (select item_id, unnest({_TERMS}) term from benchmark) group by all),
w as (select item_id, term, q * floor(1000.0 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint w from q join df using (term), total),
m as (select doc_id, 75 + (25 * n * docs) // terms m from n, total),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score from w join tf using (term) join m using (doc_id) group by all having sum(w) > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int rank, doc_id, score from s where score > 0
qualify rank <= 20
"""
