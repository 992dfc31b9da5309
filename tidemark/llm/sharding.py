"""Sharding over a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.batches import aside
from tidemark.session import table

#: Rows that one hash range of a shard holds, about; and ranges to a shard, at least.
RANGE, CELLS = 50_000, 256

Tree = dict[str, dict[str, dict[int, float]]]


def layout(shards: int, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Tree:
    """The tree of so many shards, in the order in which they join: ``per_rack`` fill a rack, ``racks`` a region. Shards
    weigh 1 unless given."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region {rack // racks}", {}).setdefault(f"rack {rack}", {})[s] = (weights or {}).get(s, 1.0)
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    """A node's draw for a key: an exponential variable with the node's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def assign(key: Column, tree: Tree) -> Column:
    """The shard of a key in a tree whose weights may change anywhere: at each level every child makes
    one draw, scaled by its summed weight, and the least is followed; other branches draw nothing.

    A node's draw depends on its own name and weight alone. So a change of weights moves keys only
    into or out of the subtrees whose weight changes, and within them. For a tree that grows at its end ``place`` moves less. Nodes without weight get nothing. A null key is a key like any other.
    """
    k = F.coalesce(key.cast("string"), F.lit("~"))

    def weight(node) -> float:
        return sum(map(weight, node.values())) if isinstance(node, dict) else max(0.0, float(node))

    def down(children: dict, path: str) -> Column:
        live = [(name, child, weight(child)) for name, child in children.items() if weight(child) > 0]
        goal = [down(child, f"{path}/{name}") if isinstance(child, dict) else F.lit(name) for name, child, _ in live]
        if len(live) == 1:
            return goal[0]
        draws = [_draw(k, f"{path}/{name}", w) for name, _, w in live]
        out = goal[-1]
        for d, g in reversed(list(zip(draws[:-1], goal))):
            out = F.when(d == F.least(*draws), g).otherwise(out)
        return out

    if weight(tree) <= 0:
        raise ValueError("the tree has no shard with weight")
    return down(tree, "")


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key in a tree that grows at its end: region, then rack, then shard.

    The children of a node stand in the order in which they joined. From the last on, a child takes the key if its draw, one for
    each node, is below its weight's share of all weight up to its own end; so every shard gets its
    weight's share. A region that takes a key took it when its weight first made the share exceed the draw: the rack and
    the shard that held that piece of weight have the key, unless a later one of their siblings takes it by its own
    draw. What joins at the end changes shares from there on only, so it takes keys only into itself, whatever the number of
    shards, and the draws of all others stay. Nodes without weight get nothing. A null key is a key like any other.
    """
    k = F.coalesce(key.cast("string"), F.lit("~"))

    def weight(node) -> float:
        return sum(map(weight, node.values())) if isinstance(node, dict) else max(0.0, float(node))

    def share(path: str) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(k, F.lit(path)), 11)
        return (bits.cast("double") + 0.5) / float(1 << 53)

    def down(children: dict, path: str, before: float, entry: Column | None) -> Column:
        """``before``: weight of all that joined before these children; ``entry``: the weight at which their parent took the key."""
        live, at = [], before
        for name, child in children.items():
            if (w := weight(child)) > 0:
                live.append((name, child, at, w))
                at += w
        out = None
        for name, child, start, w in live:
            draw = share(f"{path}/{name}")
            held = F.lit(False) if entry is None else entry > start
            if isinstance(child, dict):
                own = F.lit(start) / (1.0 - draw)  # the weight at which the child's own draw takes the key
                goal = down(child, f"{path}/{name}", start, own if entry is None else F.when(held, entry).otherwise(own))
            else:
                goal = F.lit(name)
            out = goal if out is None else F.when(held | (draw < w / (start + w)), goal).otherwise(out)
        return out

    if weight(tree) <= 0:
        raise ValueError("the tree has no shard with weight")
    return down(tree, "", 0.0, None)


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` counts a shard's rows from 0 without gaps: rows are numbered within one hash range of
    their shard and the ranges' counts are added up, with as many ranges as the counted rows ask
    for, so no task gets a whole shard. Equal rows may swap slots. A null text counts as empty; an
    empty table gives an empty result; a very long text is one row; columns of the same names as
    the made ones are replaced, all others kept, whatever their names.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c not in made or c in (text, key)]
    return aside(docs, (text, key), made, lambda d: _shard(d, tree, grown, key, text)).select(*kept, *[c for c in made if c not in kept])


def _shard(docs: DataFrame, tree: Tree, grown: Tree | None, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("size", (F.octet_length(body) + 1).cast("long")).withColumn("text_crc32", F.crc32(body.cast("binary")).cast("long"))
    d = d.withColumn("law", F.lit("key")).withColumn("shard", place(F.col(key), tree).cast("int"))
    d = d.withColumn("grown_shard", (place(F.col(key), grown) if grown else F.lit(None)).cast("int"))
    return _numbered(d, key, max(CELLS, docs.count() // RANGE))


def _numbered(d: DataFrame, key: str, cells: int) -> DataFrame:
    """Adds ``slot`` to rows that have ``shard``, ``text_crc32`` and ``size``."""
    d = d.withColumn("_c", F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(cells)))
    over = Window.partitionBy("shard").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("shard", "_c").agg(F.count("*").alias("n")).select("shard", "_c", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "_c").orderBy(F.col(key).asc_nulls_last(), "text_crc32", "size")
    d = d.withColumn("_r", F.row_number().over(within)).join(before, ["shard", "_c"])
    return d.withColumn("slot", (F.col("before") + F.col("_r") - 1).cast("long")).drop("_c", "_r", "before")


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, layout(8), layout(9)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
