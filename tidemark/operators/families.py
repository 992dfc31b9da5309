"""Families of records: connected components over shared keys and set similarity, with guards."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.filters import bloom, may_hold
from tidemark.operators.components import connected_components
from tidemark.session import cut, written


class DuplicateNodeError(ValueError):
    """A node id occurs more than once."""


class PercolationError(ValueError):
    """One family holds so much that a split by families would be meaningless."""


def star_edges(keys: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """An edge from each node to the smallest node with the same key; blank keys link nothing."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("value")) for c in columns])
    long = keys.select(F.col(node).alias("node"), F.explode(pairs).alias("_k")).select("node", "_k.*").where("value is not null")
    low = long.groupBy("kind", "value").agg(F.min("node").alias("low"))
    return long.join(low, ["kind", "value"]).where("node <> low").select("kind", F.col("node").alias("src"), F.col("low").alias("dst"))


def families(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """Every node with its ``family_id``: the smallest node of its component."""
    found = connected_components(edges)
    return nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("family_id", F.coalesce("component", node)).drop("component")


def key_families(keys: DataFrame, node: str, columns: list[str], check: bool = True) -> DataFrame:
    """Families over shared keys. A repeated node id is an error."""
    if check:
        twice = keys.groupBy(node).count().where("count > 1").limit(5).collect()
        if twice:
            raise DuplicateNodeError(f"{node}: {sorted(r[0] for r in twice)}")
    return families(keys, node, star_edges(keys, node, columns))


def rule_merges(keys: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """By how much each key, applied in order, lowers the number of families."""
    spark, rows = keys.sparkSession, []
    edges = cut(star_edges(keys, node, columns))
    before = keys.count()
    for i, c in enumerate(columns):
        used = edges.where(F.col("kind").isin(columns[: i + 1]))
        after = families(keys.select(node), node, used).select("family_id").distinct().count()
        rows.append((c, before - after))
        before = after
    return spark.createDataFrame(rows, "rule string, merges long")


def family_summary(assigned: DataFrame) -> DataFrame:
    """Families by size."""
    return assigned.groupBy("family_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


def assert_no_percolation(assigned: DataFrame, most: float = 0.20, least_nodes: int = 200) -> None:
    """E5: raises if the largest family of at least ``least_nodes`` nodes holds more than ``most`` of them."""
    sizes = assigned.groupBy("family_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    if most < 1.0 and (sizes["all"] or 0) >= least_nodes and sizes["top"] > most * sizes["all"]:
        raise PercolationError(f"largest family: {sizes['top']} of {sizes['all']}")


def set_classes(sets: DataFrame, node: str = "node", items: str = "items") -> tuple[DataFrame, DataFrame]:
    """Equal sets as one class: ``(rep, n, items)`` by class, and ``(rep, node)`` for all others.

    A class is found by 128 bits of its sorted items; members meet their representative by that
    key, so no list of members is ever built, and no items are shuffled: representatives' sets are
    written where they are scanned. Sets without items belong to no class.
    """
    keyed = sets.where((F.size(items) > 0) & F.col(node).isNotNull()).select(F.col(node).alias("node"), F.array_sort(F.array_distinct(F.col(items))).alias("items"))
    keyed = keyed.withColumn("_a", F.xxhash64("items")).withColumn("_b", F.xxhash64("items", F.lit(1)))
    by = ["node", "_a", "_b"]
    narrow = cut(keyed.select(*by))
    members = cut(narrow.join(cut(narrow.groupBy("_a", "_b").agg(F.min("node").alias("rep"))), ["_a", "_b"]))
    others = members.where("rep <> node")
    one = written(among(keyed, by, members.where("rep = node"), others).select(F.col("node").alias("rep"), F.size("items").alias("n"), "items"))
    return one, others.select("rep", "node")


def may_be(rows: DataFrame, by: list[str], keys: DataFrame) -> DataFrame:
    """The rows whose columns ``by`` may be those of a row of ``keys`` (materialised): a Bloom filter drops nearly all others where
    they are scanned, so that wide rows are not shuffled to find this out."""
    bits, names = bloom(keys.select(F.xxhash64(*by).alias("_h")), "_h", keys.count()), rows.columns

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits, batch.column("_h").to_numpy()))).select(names)

    return rows.withColumn("_h", F.xxhash64(*by)).mapInArrow(run, rows.schema)


def among(rows: DataFrame, by: list[str], keys: DataFrame, rest: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows whose columns ``by`` are those of a row of ``keys``, if those of all others are in ``rest`` (both materialised). What the
    filter lets through of ``rest`` is taken out by a join, broadcast up to ``most`` rows."""
    wrong = cut(may_be(rest.select(*by), by, keys))
    return may_be(rows, by, keys).join(F.broadcast(wrong) if wrong.count() <= most else wrong, by, "left_anti")


@dataclass(frozen=True)
class ItemOrder:
    """One order of items for all sides of a join: rare ones by value, then ``last`` (sorted) by ``rank``. It changes no result."""

    last: np.ndarray
    rank: np.ndarray

    def prefix(self, items: list[int], least: float) -> np.ndarray:
        """The first items of a set, of which a similar set shares at least one."""
        s = np.array(items, np.int64)
        late = np.zeros(len(s), np.int64)
        if len(self.last):
            k = np.minimum(np.searchsorted(self.last, s), len(self.last) - 1)
            late = np.where(self.last[k] == s, self.rank[k], 0)
        return s[np.lexsort((s, late))][: len(s) - math.ceil(len(s) * least - 1e-9) + 1]


def item_order(classes: list[DataFrame], common: int = 65_536, seen: int = 4, sample: int = 8) -> ItemOrder:
    """The ``common`` commonest items (of those in ``seen`` sets or more of a ``sample``-th of the sets, half a megabyte for the
    tasks) go last, by rising frequency."""
    parts = [c.where(F.pmod(F.xxhash64("rep"), F.lit(sample)) == 0).select(F.explode("items").alias("item")) for c in classes]
    often = reduce(DataFrame.unionByName, parts).groupBy("item").agg(F.count("*").alias("df")).where(F.col("df") >= seen).orderBy(F.desc("df"), "item").limit(common).toPandas()
    last = often["item"].to_numpy(np.int64)
    order = np.argsort(last)
    return ItemOrder(last[order], len(last) - order)


def prefixes(classes: DataFrame, order: ItemOrder, least: float) -> DataFrame:
    """``(rep, n, p, item)``: the prefix of each set in the order, with the set's size and the items' places from 0."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = part.column("items").to_pylist()
                item = [order.prefix(s, least) for s in sets]
                reach = np.array([len(x) for x in item])
                whose = pa.array(np.repeat(np.arange(len(sets)), reach))
                place = np.concatenate([np.arange(r, dtype=np.int32) for r in reach.tolist()])
                size = np.repeat(np.array([len(s) for s in sets], np.int32), reach)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(whose), pa.array(size), pa.array(place), pa.array(np.concatenate(item))], names=["rep", "n", "p", "item"])

    return classes.select("rep", F.col("items").cast("array<long>").alias("items")).mapInArrow(run, f"rep {kind}, n int, p int, item long")


def _fits(least: float) -> Column:
    """Sizes and places that leave room for the overlap that similar sets of these sizes need, on both sides."""
    o = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    near = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    return near & (F.col("pa") + o <= F.col("na")) & (F.col("pb") + o <= F.col("nb"))


def _need(least: float) -> Column:
    """How many items the prefixes of similar sets of these sizes share, at least.

    Items that two sets share and that are not in both prefixes stand behind the prefix that ends first in the order, so there are
    fewer of them than the longer of the two rests; the prefixes must share what the required overlap has beyond that."""
    rest = F.greatest(*[F.ceil(F.col(n) * least - 1e-9) - 1 for n in ("na", "nb")])
    return F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9) - rest


def _may_suffice(met: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of meetings by item (each once) whose places leave room and whose number allows similarity."""
    pairs = met.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b"), _need(least).alias("need"), _fits(least).alias("fits"))
    return pairs.groupBy("a", "b", "need").agg(F.count("*").alias("k"), F.max("fits").alias("fits")).where("fits and k >= need").select("a", "b")


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(x.toDF(*[f"{c}{i}" if c != "item" else c for c in x.columns]) for x, i in ((a, "a"), (b, "b")))


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` (materialised) whose sets are similar, with their ``similarity``. Only sets that a pair names are shuffled."""
    sides = [may_be(x.select("rep", "items").toDF(c, f"s{c}"), [c], pairs.select(c)) for x, c in ((left, "a"), (right, "b"))]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (inter / (F.size("sa") + F.size("sb") - inter)).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def similar_pairs(sets: DataFrame, least: float = 0.75, node: str = "node", items: str = "items", common: int = 65_536, seen: int = 4, sample: int = 8) -> DataFrame:
    """C14: ``(a, b, similarity)``, a < b, of sets with Jaccard of at least ``least``.

    Equal sets are one, each member paired with its representative. Items (longs or integers) stand in one ``item_order``.
    Of two similar sets the first shared item stands, in both, early enough to leave room for the
    overlap that their sizes require, so only prefixes are joined; what meets is verified exactly.
    """
    one, others = set_classes(sets, node, items)
    head = _shared(prefixes(one, item_order([one], common, seen, sample), least))
    a, b = _sides(head, head)
    pairs = _may_suffice(a.join(b, "item").where("repa < repb"), least)
    return _verified(cut(pairs), one, one, least).unionByName(others.select(F.col("rep").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("similarity")))


def _shared(head: DataFrame) -> DataFrame:
    """Prefix rows whose item other sets have, too, with the number ``m`` of those sets. Counts are combined before the shuffle, rows that
    a filter of the counted items drops are not shuffled, and both sides of the join are written, so that adaptive execution can split a hot item."""
    head = written(head)
    often = written(head.groupBy("item").agg(F.count("*").alias("m")).where("m > 1"))
    return written(written(may_be(head, ["item"], often)).join(often, "item").select("rep", "n", "p", "item", "m"))


def similar_across(left: DataFrame, right: DataFrame, least: float = 0.75, node: str = "node", items: str = "items") -> DataFrame:
    """C15 with a floor: ``(a, b, similarity)`` for every set ``a`` of ``left`` and ``b`` of ``right`` with Jaccard of at least ``least``.

    Both tables stand in one order of items, so two similar sets share an item of both their prefixes; only items that both
    tables have in prefixes are joined, and sizes and places bound what can meet on either side. Equal sets of a table are
    one until pairs are written out, and sets that are equal across the tables meet by themselves, without a prefix.
    Sets without items meet nothing.
    """
    (one, more), (two, others) = set_classes(left, node, items), set_classes(right, node, items)
    order = item_order([one, two])
    heads = [written(prefixes(x, order, least)) for x in (one, two)]
    few, many = [h.select("item").distinct() for h in heads]
    few = cut(few)
    shared = cut(few.join(may_be(many, ["item"], few), "item", "left_semi"))
    a, b = _sides(*[cut(written(may_be(h, ["item"], shared)).join(shared.select(F.col("item").alias("_i")), F.col("item") == F.col("_i")).select("rep", "n", "p", "item")) for h in heads])
    pairs = a.join(b, "item").where(_fits(least)).select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()
    same = one.select(F.col("rep").alias("a"), "items").join(two.select(F.col("rep").alias("b"), "items"), "items").select("a", "b")
    found = cut(_verified(cut(pairs.join(same, ["a", "b"], "left_anti")), one, two, least).unionByName(same.select("a", "b", F.lit(1.0).alias("similarity"))))
    members = lambda classes, rest, name: classes.select(F.col("rep"), F.col("rep").alias(name)).unionByName(rest.select("rep", F.col("node").alias(name)))
    out = found.toDF("_a", "_b", "similarity").join(members(one, more, "a").withColumnRenamed("rep", "_a"), "_a").join(members(two, others, "b").withColumnRenamed("rep", "_b"), "_b")
    return out.select("a", "b", "similarity")


def bands(least: float, recall: float = 0.95, hashes: int = 128) -> tuple[int, int]:
    """Rows of a band and number of bands for minhashes: the longest bands, hence the fewest chance meetings, of which ``hashes`` hold
    enough that two sets of similarity ``least`` agree in one with a probability of ``recall``."""
    for rows in range(hashes, 0, -1):
        count = math.ceil(math.log(1 - recall) / math.log1p(-(least**rows))) if least < 1 else 1
        if count * rows <= hashes:
            return rows, count
    return 1, hashes


def minhash_pairs(sets: DataFrame, least: float = 0.75, node: str = "node", items: str = "items", recall: float = 0.95, hashes: int = 128, seed: int = 7) -> DataFrame:
    """C14's approximate twin: ``(a, b, similarity)``, a < b, of sets that agree in a band of minhashes and have Jaccard of at least ``least``.

    Nothing below ``least`` is returned, and each pair at or above it is found with a probability of at least ``recall``, that of a pair at ``least``; ``bands``
    chooses how many rows a band has. Equal sets are one, as in ``similar_pairs``. A task sends a row for each set and band, whatever the set's size.
    """
    one, others = set_classes(sets, node, items)
    rows, count = bands(least, recall, hashes)
    r = np.random.default_rng(seed)
    a, b = (r.integers(1, 1 << 63, rows * count, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    kind = one.schema["rep"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = []
                for s in part.column("items").to_pylist():
                    h = np.array(s, np.int64).view(np.uint64)
                    low = np.full(rows * count, np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(h), 1024):  # a part of a large set at a time
                        x = h[k : k + 1024, None] * a + b
                        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=0))
                    band = np.zeros(count, np.uint64)
                    for column in low.reshape(count, rows).T:
                        band = (band ^ column) * np.uint64(0xD6E8FEB86659FD93)
                        band ^= band >> np.uint64(32)
                    keys.append(band.view(np.int64))
                whose = pa.array(np.repeat(np.arange(part.num_rows), count))
                yield pa.RecordBatch.from_arrays([part.column("rep").take(whose), pa.array(np.tile(np.arange(count, dtype=np.int32), part.num_rows)), pa.array(np.concatenate(keys))], names=["rep", "band", "item"])

    found = cut(one.select("rep", F.col("items").cast("array<long>").alias("items")).mapInArrow(run, f"rep {kind}, band int, item long"))
    again = cut(found.groupBy("band", "item").agg(F.count("*").alias("_m")).where("_m > 1").select("band", "item"))
    met = cut(found.join(again, ["band", "item"]))
    pairs = met.withColumnRenamed("rep", "a").join(met.withColumnRenamed("rep", "b"), ["band", "item"]).where("a < b").select("a", "b").distinct()
    return _verified(cut(pairs), one, one, least).unionByName(others.select(F.col("rep").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("similarity")))


def set_components(sets: DataFrame, least: float = 0.75, node: str = "node", items: str = "items", seen: int = 4) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all similar pairs of sets (Jaccard of at least ``least``).

    Not all pairs are looked at: each set is compared with the one of those it meets that shares most of its prefix with others, which links a
    group of near copies to its centre; what follows joins only sets of unlike components, and of an
    item's largest component only meetings with others. So a group of near copies costs about one comparison a
    member, and no link between components is lost.
    """
    one, others = set_classes(sets, node, items)
    head = _shared(prefixes(one, item_order([one], seen=seen), least))
    weight = cut(head.groupBy("rep").agg(F.sum("m").alias("w"), F.count("*").alias("k")))
    each = written(head.join(weight, "rep").drop("m"))
    centre = cut(each.groupBy("item").agg(F.max(F.struct("w", "rep", "n", "p", "k")).alias("t")).select("item", F.col("t.w").alias("w"), F.col("t.rep").alias("repb"), F.col("t.n").alias("nb"), F.col("t.p").alias("pb"), F.col("t.k").alias("kb")))
    met = each.select("item", F.col("rep").alias("repa"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("k").alias("ka")).join(centre, "item").where("repa <> repb")
    # two sets share no more of their prefixes than either shares with any other set
    met = met.where(_fits(least) & (F.least("ka", "kb") >= _need(least)))
    best = met.groupBy("repa", "repb", "w").agg(F.count("*").alias("k")).groupBy("repa").agg(F.max(F.struct("k", "w", "repb")).alias("t"))
    links = cut(_verified(cut(best.select(F.col("repa").alias("a"), F.col("t.repb").alias("b"))), one, one, least).select("a", "b"))
    found = cut(connected_components(links, "a", "b"))
    rows = head.drop("m").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    by = rows.groupBy("item", "c").agg(F.count("*").alias("m")).groupBy("item").agg(F.max(F.struct("m", "c")).alias("t"), F.count("*").alias("parts"))
    open_ = cut(rows.join(by.where("parts > 1").select("item", F.col("t.c").alias("d")), "item"))
    a, b = _sides(open_.where("c <> d"), open_)
    # pairs outside the largest component are made once, those with it from the other side
    pairs = _may_suffice(a.join(b, "item").where("ca <> cb and (cb = db or repa < repb)"), least)
    more = _verified(cut(pairs), one, one, least).select("a", "b")
    return links.unionByName(more).unionByName(others.select(F.col("rep").alias("a"), F.col("node").alias("b"))).toDF("dst", "src").select("src", "dst")


def similarity_families(keys: DataFrame, node: str, columns: list[str], sets: DataFrame, least: float = 0.75) -> DataFrame:
    """Families over shared keys and set similarity."""
    return families(keys, node, star_edges(keys, node, columns).select("src", "dst").unionByName(set_components(sets, least)))


def joint_families(queries: DataFrame, pool: DataFrame, node: str, exact: str, columns: list[str], items: str | None = None, least: float = 0.75, sets: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Families over queries and pool together, one node for each exact key; both sides with ``family_id``.

    A key's node is its first row, queries before pool, then by id. A row without an exact key
    is a node of its own. Nodes are linked by equal keys in ``columns`` and, with ``items`` (an array column) or ``sets`` (``node, items``
    of either side), by sets of Jaccard ``least`` or more, within a table as across the two. Family ids are the node ids ``q:<id>`` and ``p:<id>``.
    """
    if items:
        queries, pool = written(queries), written(pool)  # what makes the sets runs once
        sets = tuple(side.select(F.col(node).alias("node"), F.col(items).alias("items")) for side in (queries, pool))
        queries, pool = queries.drop(items), pool.drop(items)
    name = lambda mark, column: F.concat(F.lit(f"{mark}:"), F.col(column).cast("string"))
    rows = [side.withColumn("_n", name(mark, node)).withColumn("_x", F.coalesce(F.nullif(F.trim(exact), F.lit("")), F.concat(F.lit("~"), "_n"))).withColumn("_side", F.lit(i)) for i, (side, mark) in enumerate(((queries, "q"), (pool, "p")))]
    both = rows[0].select("_side", "_x", "_n", node, *columns).unionByName(rows[1].select("_side", "_x", "_n", node, *columns))
    first = cut(both.groupBy("_x").agg(F.min_by(F.struct("_n", *columns), F.struct("_side", node)).alias("f")).select("_x", "f.*"))
    edges = star_edges(first, "_n", columns).select("src", "dst")
    if sets:
        rest = cut(both.select("_n").join(first.select("_n"), "_n", "left_anti"))
        named = reduce(DataFrame.unionByName, [side.select(name(mark, "node").alias("_n"), "items") for side, mark in zip(sets, "qp")])
        edges = edges.unionByName(set_components(among(named, ["_n"], first, rest), least, "_n"))
    assigned = cut(families(first, "_n", edges).select("_x", "family_id"))
    return tuple(side.join(assigned, "_x").drop("_x", "_n", "_side") for side in rows)
