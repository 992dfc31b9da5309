"""N-gram Jaccard join by vertical partitioning, up to exact link components.

Documents with the same words are one class. A class is a set of 64-bit n-gram hashes in one
global order: rare n-grams first, by hash, then the commonest, by rising frequency. The order
is cut into fragments; a row holds what one class has in one fragment, the overlaps of a pair are
counted fragment by fragment and summed.

Which pairs are counted is decided without losing a link:

* Similar sets share n-grams of their prefixes of ``n - ceil(t n) + 1``, at least ``required(n1, n2)`` of
  them; only rows of such n-grams are shuffled.
* Only components are asked for, so a pair within a component that is already linked is not
  looked at. Every class is first compared with the most typical class that it meets, which
  links groups of near copies; what follows looks only at pairs across components.
* Two similar sets of ``n1`` and ``n2`` n-grams share ``o = overlap(n1, n2)``; the first shared one in
  the global order stands at most ``n1 - o`` and ``n2 - o`` places from the start. So a place in a
  set says which sizes its partner may have; an n-gram meets only sets of such sizes. N-grams of a
  large group stand last in the order, so members too unlike its centre to link do not meet there.
* Of each n-gram's largest component only meetings with others are made, never those within.

So groups of near copies cost about one comparison a member.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.filters import bloom, may_hold
from tidemark.llm.batches import U64, Words, chunks, lower_table, mix64, pieces
from tidemark.operators.components import connected_components
from tidemark.session import cut, release, table

#: Words of a shingle; similarity in hundredths.
WIDTH, PERCENT = 5, 75
#: Ranges of the global order whose overlaps are counted apart, at least; and the n-grams that the
#: largest set has in one of them, about.
FRAGMENTS, PART = 4, 65_536
#: One class in so many is looked at for common n-grams; those seen at least so often are
#: common, but at most so many of them (one megabyte, the only broadcast) go last in the order.
SAMPLE, SEEN, COMMON = 16, 4, 65_536
#: Characters hashed at once, and classes a task remembers having sent.
BATCH, REMEMBERED = 250_000, 1 << 17
#: Bits of the filter that keeps unneeded classes from being sent.
FILTER_BITS = 1 << 24
#: Size buckets to a factor of e, in which partners are looked for.
BUCKETS = 16

_SPACE = lower_table("space")
_STEP = mix64(np.arange(1, WIDTH + 1, dtype=U64)) | U64(1)
_A, _B = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


class Sets:
    """N-gram sets of a list of texts, made when asked for.

    ``key`` is a 64-bit hash of a text's whole word sequence (0 without words).
    """

    def __init__(self, texts: list[str]):
        parts = [pieces(t) for t in texts]
        if all(len(p) == 1 for p in parts):
            w = Words(texts, _SPACE)
            h, self.count = w.hash, w.count
        else:  # a very long text goes part by part, of which only the words' hashes stay
            each = [[Words([x], _SPACE).hash for x in p] for p in parts]
            self.count = np.array([sum(map(len, e)) for e in each], dtype=np.int64)
            h = np.concatenate([x for e in each for x in e])
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        n = len(h)
        place = np.arange(n) - np.repeat(self.first[:-1], self.count)
        power = np.cumprod(np.full(int(self.count.max(initial=0)) + 1, _A, dtype=U64), dtype=U64)
        total = np.zeros(n + 1, U64)
        np.cumsum(h * power[place], dtype=U64, out=total[1:])
        self.key = mix64(total[self.first[1:]] - total[self.first[:-1]] + self.count.astype(U64) * U64(_B))
        self.key[self.count == 0] = 0
        g = np.zeros(n, U64)
        for k in range(min(WIDTH, n)):
            g[: n - k] += h[k:] * _STEP[k]
        self.gram = mix64(g)

    def ids(self) -> np.ndarray:
        return self.key.view(np.int64)

    def grams(self, i: int) -> np.ndarray:
        """The sorted distinct n-grams of text ``i``; a text of fewer words has one, the whole."""
        n = int(self.count[i])
        if n == 0:
            return np.empty(0, U64)
        if n < WIDTH:
            return self.key[i : i + 1]
        a = int(self.first[i])
        s = np.sort(self.gram[a : a + n - WIDTH + 1])
        return s[np.concatenate([[True], s[1:] != s[:-1]])]


def overlap(n1: Column, n2: Column) -> Column:
    """What similar sets of these sizes share, at least."""
    return F.ceil((n1 + n2) * PERCENT / (100 + PERCENT) - 1e-9)


def required(n1: Column, n2: Column) -> Column:
    """How many n-grams similar sets of these sizes share within both prefixes, at least.

    With the overlap ``o`` they need, a set has at most ``n - o`` n-grams of its own, so the prefix
    that ends first holds at least its length less that many shared ones.
    """
    own = lambda n: 1 - F.ceil(n * PERCENT / 100 - 1e-9)  # noqa: E731  prefix less size
    return F.greatest(F.lit(1), F.least(own(n1), own(n2)) + overlap(n1, n2))


def near_in_size(n1: Column, n2: Column) -> Column:
    return (n1 * 100 >= n2 * PERCENT) & (n2 * 100 >= n1 * PERCENT)


def prefix(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


def classes(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``c, n`` and, for a sample of classes, all ``grams``."""

    def run(batches):
        for part, texts in chunks(batches, text, BATCH):
            sets = Sets(texts)
            n, grams = [], []
            for i, c in enumerate(sets.key.tolist()):
                s = sets.grams(i)
                n.append(len(s))
                grams.append(s.view(np.int64) if len(s) and c % SAMPLE == 0 else None)
            cols = [pa.array(sets.ids()), pa.array(n, pa.int64()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *cols], names=[*keep, "c", "n", "grams"])

    source = docs.select(*keep, text)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    return source.mapInArrow(run, schema + "c long, n long, grams array<long>")


@dataclass(frozen=True)
class Order:
    """The global order: ``last`` are the common n-grams, sorted, ``rank`` their places among each other."""

    last: np.ndarray
    rank: np.ndarray

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """Sorted n-grams in the global order, and how many of them are rare."""
        if not len(self.last):
            return s, len(s)
        at = np.minimum(np.searchsorted(self.last, s), len(self.last) - 1)
        late = self.last[at] == s
        if not late.any():
            return s, len(s)
        return np.concatenate([s[~late], s[late][np.argsort(self.rank[at[late]])]]), int((~late).sum())


def global_order(found: DataFrame) -> Order:
    """The commonest n-grams of the sampled classes. They only shape the order, so a sample and a
    bound cannot lose a pair."""
    sampled = found.where("grams is not null").groupBy("c").agg(F.first("grams").alias("grams"))
    seen = sampled.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") >= SEEN)
    top = seen.orderBy(F.desc("k"), "g").limit(COMMON).select("g").toArrow()
    g = top.column("g").to_numpy().astype(np.int64).view(U64)
    place = np.argsort(g)
    return Order(g[place], (len(g) - place).astype(np.int32))


def postings(docs: DataFrame, text: str, order: Order, only: np.ndarray | None = None) -> DataFrame:
    """``(g, c, n, p)``: the prefix of every class in the global order, with the places from 0, or of it what the filter
    ``only`` lets through. A task skips classes it had."""

    def run(batches):
        had: set[int] = set()
        for _, texts in chunks(batches, text, BATCH):
            sets = Sets(texts)
            out, which, size, place = [], [], [], []
            for i, c in enumerate(sets.key.tolist()):
                if c == 0 or c in had:
                    continue
                if len(had) < REMEMBERED:
                    had.add(c)
                s, _ = order.sort(sets.grams(i))
                at = np.arange(prefix(len(s)), dtype=np.int32)
                if only is not None:
                    at = at[may_hold(only, s[at])]
                out.append(s[at])
                which.append(np.full(len(at), c, U64))
                size.append(np.full(len(at), len(s), np.int32))
                place.append(at)
            if out:
                cols = [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(which).view(np.int64)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place))]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "c", "n", "p"])

    return docs.select(text).mapInArrow(run, "g long, c long, n int, p int")


def fragments(docs: DataFrame, text: str, needed: DataFrame, order: Order, number: int) -> DataFrame:
    """``(c, f, grams)``: what each class in ``needed`` has in each fragment of the global order.

    The last fragment holds the common n-grams, the others equal ranges of the rare ones. A
    filter of fixed size keeps most other classes from being sent; a class that several
    documents have is kept once.
    """
    at = F.pmod(F.col("c"), F.lit(FILTER_BITS))
    words = needed.select(F.floor(at / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(c & 63L as int))").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, U64)
    set_words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits[set_words.column("w").to_numpy()] = set_words.column("b").to_numpy().view(U64)

    def run(batches):
        cuts = np.array([(k << 64) // (number - 1) for k in range(1, number - 1)], dtype=U64)
        had: set[int] = set()
        for _, texts in chunks(batches, text, BATCH):
            sets = Sets(texts)
            low = sets.key & U64(FILTER_BITS - 1)
            want = (bits[(low >> U64(6)).astype(np.int64)] >> (low & U64(63))) & U64(1)
            c, f, parts = [], [], []
            for i in np.flatnonzero((want != 0) & (sets.key != 0)).tolist():
                k = int(sets.ids()[i])
                if k in had:
                    continue
                if len(had) < REMEMBERED:
                    had.add(k)
                s, rare = order.sort(sets.grams(i))
                ends = [0, *np.searchsorted(s[:rare], cuts).tolist(), rare, len(s)]
                for x in range(number):
                    if ends[x + 1] > ends[x]:
                        c.append(k)
                        f.append(x)
                        parts.append(s[ends[x] : ends[x + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["c", "f", "grams"])

    sent = docs.select(text).mapInArrow(run, "c long, f int, grams array<long>")
    return sent.groupBy("c", "f").agg(F.first("grams").alias("grams"))


def linked(pairs: DataFrame, parts: DataFrame, number: int) -> DataFrame:
    """The pairs ``(c1, c2)`` that reach the similarity, by overlaps counted in each fragment and summed.

    A row is one fragment of one pair. ``parts`` is materialised, so that adaptive execution can
    split the rows of a class that many pairs have.
    """
    each = pairs.select("c1", "c2", "n1", "n2", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("f"))
    each = each.join(parts.toDF("c1", "f", "g1"), ["c1", "f"]).join(parts.toDF("c2", "f", "g2"), ["c2", "f"])
    counted = each.select("c1", "c2", "n1", "n2", F.size(F.array_intersect("g1", "g2")).alias("o"))
    summed = counted.groupBy("c1", "c2", "n1", "n2").agg(F.sum("o").alias("o"))
    return summed.where(F.col("o") * 100 >= (F.col("n1") + F.col("n2") - F.col("o")) * PERCENT).select("c1", "c2")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("c1").alias("c")).distinct().unionByName(pairs.select(F.col("c2").alias("c")).distinct()).distinct()


def star_pairs(lists: DataFrame) -> DataFrame:
    """``(c1, c2, n1, n2)``: each class with the most typical class that it meets. One pair a class.

    A class is the more typical, the more classes have the n-grams of its prefix; each n-gram
    has one most typical class, and of those that a class meets the one it meets most often is taken.
    """
    weight = cut(lists.groupBy("c").agg(F.sum("m").alias("w")))
    each = cut(lists.select("g", "c", "n").join(weight, "c"))
    top = cut(each.groupBy("g").agg(F.max(F.struct("w", "c", "n")).alias("t")).select("g", F.col("t.c").alias("tc"), F.col("t.n").alias("tn"), F.col("t.w").alias("tw")))
    met = each.join(top, "g").where("c <> tc").where(near_in_size(F.col("n"), F.col("tn")))
    agree = met.groupBy("c", "n", "tc", "tn", "tw").agg(F.count("*").alias("k"))
    best = agree.groupBy("c", "n").agg(F.max(F.struct("k", "tw", "tc", "tn")).alias("t"))
    return best.select(F.col("c").alias("c1"), F.col("t.tc").alias("c2"), F.col("n").alias("n1"), F.col("t.tn").alias("n2"))


def _with_component(df: DataFrame, component: DataFrame, column: str, name: str) -> DataFrame:
    named = component.select(F.col("node").alias(column), F.col("component").alias("_to"))
    return df.join(named, column, "left").withColumn(name, F.coalesce("_to", column)).drop("_to")


def candidate_pairs(lists: DataFrame, component: DataFrame) -> DataFrame:
    """``(c1, c2, n1, n2)``: pairs across components that meet at an n-gram of both their prefixes.

    Each row of an n-gram outside its largest component looks for partners, in the size buckets that
    its place allows; the largest component only answers.
    """
    total = 100 + PERCENT
    rows = _with_component(lists, component, "c", "k")
    by = rows.groupBy("g", "k").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    heads = by.groupBy("g").agg(F.max(F.struct("m", "k")).alias("t"), F.count("*").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    heads = cut(heads.where("parts > 1").select("g", F.col("t.k").alias("d"), "low", "high"))
    met = cut(rows.join(heads, "g"))
    bucket = lambda n: F.floor(F.log(n.cast("double")) * BUCKETS).cast("int")
    n, p = F.col("n").cast("long"), F.col("p").cast("long")
    least = F.greatest(F.col("low").cast("long"), F.ceil(n * PERCENT / 100 - 1e-9))
    most = F.least(F.col("high").cast("long"), F.floor(n * 100 / PERCENT + 1e-9), F.floor((n * 100 - p * total) / PERCENT + 1e-9))
    x = met.where("k <> d").select("g", "c", "n", "k", least.alias("least"), most.alias("most")).where("least <= most")
    x = x.withColumn("z", F.explode(F.sequence(bucket(F.col("least")), bucket(F.col("most")))))
    y = met.select("g", F.col("c").alias("yc"), F.col("n").alias("yn"), F.col("p").alias("yp"), F.col("k").alias("yk"), F.col("d").alias("yd"), bucket(F.col("n")).alias("z"))
    fits = F.col("yn").between(F.col("least"), F.col("most")) & ((F.col("yn").cast("long") * 100 - F.col("yp").cast("long") * total) >= F.col("n").cast("long") * PERCENT)
    both = x.join(y, ["g", "z"]).where("k <> yk").where((F.col("yk") == F.col("yd")) | (F.col("c") < F.col("yc"))).where(fits)
    first = F.col("c") < F.col("yc")
    ends = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(f"{name}{i}") for name in ("c", "n") for i, (a, b) in enumerate([(name, f"y{name}"), (f"y{name}", name)], 1)]
    return both.select(*ends).distinct()


def narrowed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose prefixes share as many n-grams as similar sets of their sizes must.

    ``held`` has ``c`` and the n-grams of its prefix that other classes have too.
    """
    both = pairs.join(held.toDF("c1", "h1"), "c1").join(held.toDF("c2", "h2"), "c2")
    return both.where(F.size(F.array_intersect("h1", "h2")) >= required(F.col("n1"), F.col("n2"))).select("c1", "c2", "n1", "n2")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", trace: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A document's set is
    its distinct ``WIDTH``-word shingles, or its whole sequence if it has fewer words. Documents link if
    100 times the intersection is at least ``PERCENT`` times the union; the component is the smallest
    key reachable. Null and empty texts, and those of white space only, have size 0 and their
    own key as component; so does an empty table have an empty result. Rows with a null key
    take part in links and get their component's smallest key (null if it has none). Repeated
    rows give repeated results. Sets are compared as 64-bit hashes.
    """

    def step(df: DataFrame) -> DataFrame:
        out = cut(df)
        release(df.sparkSession)  # what led here
        return out

    found = step(classes(docs, text, [key]))
    narrow = docs.select(text)
    number = max(FRAGMENTS, -(-(found.agg(F.max("n")).first()[0] or 0) // PART))
    order = global_order(found)
    # n-grams that several classes have in their prefixes: counted with sums in the tasks, then their rows alone are sent
    met = postings(narrow, text, order).groupBy("g").agg(F.min("c").alias("_a"), F.max("c").alias("_b"), F.count("*").alias("m"))
    met = step(met.where("_a <> _b").select("g", "m"))
    rows = step(postings(narrow, text, order, bloom(met, "g", met.count())).distinct())
    lists = step(rows.join(met, "g").select("g", "c", "n", "p", "m"))
    held = step(lists.groupBy("c").agg(F.collect_list("g").alias("held")))  # a prefix at most
    # near copies to their most typical class
    stars = step(narrowed(cut(star_pairs(lists)), held))
    links = step(linked(stars, step(fragments(narrow, text, _ends(stars), order, number)), number))
    component = step(connected_components(links, "c1", "c2"))
    # whatever else may link across components
    pairs = step(candidate_pairs(lists, component))
    kept = step(narrowed(pairs, held))
    if trace:
        trace("lists", lists)
        trace("stars", stars)
        trace("links", links)
        trace("pairs", pairs)
        trace("kept", kept)
    if kept.head(1):
        more = linked(kept, step(fragments(narrow, text, _ends(kept), order, number)), number)
        component = step(connected_components(step(links.unionByName(more)), "c1", "c2"))
    low = found.where("n > 0").groupBy("c").agg(F.min(key).alias("low"))
    low = step(_with_component(low, component, "c", "k"))
    smallest = step(low.groupBy("k").agg(F.min("low").alias("component_id")))
    by_class = step(low.select("c", "k").join(smallest, "k").select("c", "component_id"))
    wordy = found.where("n > 0").select(key, "n", "c").join(by_class, "c").select(key, F.col("n").alias("n_shingles"), "component_id")
    empty = found.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return wordy.unionByName(empty)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
