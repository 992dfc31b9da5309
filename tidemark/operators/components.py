"""Connected components of an edge list, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, release


class ConvergenceError(RuntimeError):
    """The edge set still changed after the allowed number of rounds."""


def _low(pairs: DataFrame) -> DataFrame:
    return cut(pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("low")))


def _join(pairs: DataFrame, low: DataFrame) -> DataFrame:
    # Both sides come from a materialised table, so adaptive execution can split a hub's rows.
    return pairs.join(low, pairs.u == low.k)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of an edge, component = smallest node reachable.

    Nulls and self loops are ignored as edges (a node with only self loops is its own
    component); an empty edge list gives an empty result. A round shuffles the edge list
    twice by node with a combinable ``min``; the rounds end when all edges are stars, after one
    round for stars and a logarithmic number for long chains.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = e.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = e.where("u > v")
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u points at the smallest node next to u
        large = cut(_join(both, _low(both)).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        # small star: every smaller neighbour of u, and u, point at the smallest of them
        joined = _join(large, _low(large))
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(joined.select("u", F.col("low").alias("v")))
        now = cut(small.where("u > v").distinct())
        release(now.sparkSession)  # earlier rounds
        # done when every edge leads straight to a root: each node has one edge, and no root has any
        heads = now.groupBy("u").agg(F.count("*").alias("n"), F.lit(False).alias("root"))
        roots = now.groupBy(F.col("v").alias("u")).agg(F.lit(0).cast("long").alias("n"), F.lit(True).alias("root"))
        odd = heads.unionByName(roots).groupBy("u").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n > 1 or (n > 0 and root)")
        if not odd.head(1):
            break
    else:
        raise ConvergenceError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
