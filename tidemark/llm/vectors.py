"""Embedding near-duplicates by an epsilon grid order join, exact in double precision.

Vectors of one length are sorted by grid cells on leading principal dimensions and cut into
intervals of the sequence. Pairs of intervals are made from the whole sequence down, and a pair
whose boxes are provably farther apart than epsilon is not divided further. What is left is
compared in tiles, several intervals a side, so that an interval is sent once for a tile, not for a
pair. Within a tile intervals are skipped by their boxes again, and single pairs by the bound
``cos <= p.q + r_p r_q`` of their projections and residual norms, before exact products.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.batches import aside
from tidemark.operators.components import connected_components
from tidemark.session import cut, table

#: Principal dimensions of the grid, of the intervals' boxes and of the bound on single pairs.
DIMENSIONS = 16
#: Vectors in a leaf interval of the sequence, rows compared at once, and intervals to a side of a tile.
INTERVAL, STRIP, TILE = 1024, 512, 16
#: Intervals an interval is divided into at each step of the recursion.
FAN = 4


def usable(v: Column) -> Column:
    """Whether a vector is not null, not all zero, and has only finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(part: pa.RecordBatch, column: str) -> np.ndarray:
    values = part.column(column)
    x = np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(reps: DataFrame, size: int, dimensions: int) -> np.ndarray:
    """Leading principal directions of the unit vectors, from sums made in the tasks.

    The driver gets ``size`` squared sums, whatever the number of vectors.
    """

    def run(batches):
        first, second, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            if batch.num_rows:
                u = _unit(batch, "vector")
                first += u.sum(0)
                second += u.T @ u
                n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array([[float(n), *first, *second.ravel()]], pa.list_(pa.float64()))], names=["sums"])

    sums = reps.select("vector").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    got = {r["at"]: r["x"] for r in sums.groupBy("at").agg(F.sum("x").alias("x")).collect()}
    flat = np.array([got[i] for i in range(len(got))])
    n, mean, second = max(flat[0], 1.0), flat[1 : size + 1] / max(flat[0], 1.0), flat[size + 1 :].reshape(size, size)
    _, directions = np.linalg.eigh(second / n - np.outer(mean, mean))
    return directions[:, ::-1][:, : min(dimensions, size)]


def sequence(reps: DataFrame, directions: np.ndarray, epsilon: float) -> DataFrame:
    """``reps`` with their place in epsilon grid order, as ``(rep, n, vector, place, projected)``.

    Vectors are sorted by grid cells on the principal dimensions, ties by their projection and id.
    The range-partitioned rows are materialised, so that counts by partition add up to places.
    """
    k, kind = directions.shape[1], reps.schema["vector"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            p = _unit(batch, "vector") @ directions if batch.num_rows else np.zeros((0, k))
            cells = np.floor(p / epsilon).astype(np.int32)
            cols = [pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["rep", "n", "vector", "cells", "projected"])

    schema = f"rep long, n long, vector {kind}, cells array<int>, projected array<double>"
    placed = reps.select("rep", "n", "vector").mapInArrow(project, schema)
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(n, "cells", "projected", "rep").sortWithinPartitions("cells", "projected", "rep")
    # within a partition the low 33 bits of the id count rows from 0 in sorted order
    ranged = cut(ranged.withColumn("_id", F.monotonically_increasing_id()).drop("cells"))
    part = F.shiftright("_id", 33)
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = before.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    ranged = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return ranged.select("rep", "n", "vector", "projected", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def interval_pairs(boxes: DataFrame, intervals: int, epsilon: float) -> DataFrame:
    """Pairs of leaf intervals ``(i, j)``, ``i <= j``, whose boxes are not provably farther apart than ``epsilon``.

    From the whole sequence down: a pair of intervals that is near enough is replaced by the
    pairs of their parts. ``boxes`` has ``interval, low, high`` for the leaves.
    """
    spark = boxes.sparkSession
    depth = max(0, math.ceil(math.log(max(intervals, 1), FAN) - 1e-9))
    k = F.size("low")
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    parts = F.array(*[F.lit(x).cast("long") for x in range(FAN)])
    for level in range(depth - 1, -1, -1):
        up = boxes.withColumn("interval", F.floor(F.col("interval") / FAN**level).cast("long"))
        wide = up.select("interval", F.posexplode(F.arrays_zip("low", "high")).alias("d", "b")).groupBy("interval", "d").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
        wide = wide.groupBy("interval").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("box"))
        pairs = pairs.select("j", F.col("i") * FAN, F.explode(parts).alias("a")).toDF("j", "i0", "a").select((F.col("i0") + F.col("a")).alias("i"), "j")
        pairs = pairs.select("i", F.col("j") * FAN, F.explode(parts).alias("b")).toDF("i", "j0", "b").select("i", (F.col("j0") + F.col("b")).alias("j")).where("i <= j")
        pairs = pairs.join(wide.toDF("i", "bi"), "i").join(wide.toDF("j", "bj"), "j")
        gap = lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0))
        apart = F.aggregate(F.zip_with("bi", "bj", lambda x, y: gap(x, y) * gap(x, y)), F.lit(0.0), lambda s, x: s + x)
        pairs = cut(pairs.where(apart <= (epsilon * (1 + 1e-9)) ** 2).select("i", "j"))
    return pairs


def units(packed: bytes, rows: int, kind: str) -> np.ndarray:
    x = np.frombuffer(packed, kind).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bounded(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Projections and residual norms: the product of two such rows is at least the vectors' cosine."""
    p = x @ directions
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(1)))]).astype(np.float32)


def near_pairs(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs whose cosine is at least ``least``, exact in double precision."""
    i, j = np.nonzero(bx @ by.T >= np.float32(least - 1e-5))  # single precision errs by far less
    if len(i) * 4 > len(x) * len(y):  # the bound says little here
        return np.nonzero(x @ y.T >= least)
    keep = [np.einsum("ij,ij->i", x[i[s : s + 65_536]], y[j[s : s + 65_536]]) >= least for s in range(0, len(i), 65_536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


class Tile:
    """Link counts and components of the vectors of one tile, by array operations. ``root`` is each vector's label: the smallest number in its component."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.links, self.root = counts, np.zeros(len(counts), np.int64), np.arange(len(counts))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Counts linked pairs, and joins the components of those whose ends are not joined yet."""
        n = len(self.counts)
        for x, y in ((i, j), (j, i)):
            self.links += np.bincount(x, self.counts[y], n).astype(np.int64)
        a, b = self.root[i], self.root[j]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            low = np.arange(n)  # each label's smallest neighbour, then the end of that chain
            np.minimum.at(low, a, b)
            np.minimum.at(low, b, a)
            while (low[low] != low).any():
                low = low[low]
            self.root = low[self.root]
            a, b = low[a], low[b]


def join_tiles(blocks: DataFrame, tiles: DataFrame, directions: np.ndarray, least: float, kind: str, tile: int) -> DataFrame:
    """``(rep, links, root, tried, skipped)``: for each tile, its vectors with links, counted, and one
    vector of their component within the tile; and a row of its own (null ``rep``) with the numbers of
    interval pairs. The rows are as many as vectors, not as links."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9)

    def run(part: pa.Table) -> pa.Table:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        rows = sorted(part.select(["interval", "reps", "counts", "vectors"]).to_pylist(), key=lambda r: r["interval"])
        x = [units(r["vectors"], len(r["reps"]), kind) for r in rows]
        b = [bounded(v, directions) for v in x]
        at = np.concatenate([[0], np.cumsum([len(v) for v in x])])
        reps = np.concatenate([np.array(r["reps"], np.int64) for r in rows])
        box = [(v.min(0), v.max(0)) for v in b]
        found = Tile(np.concatenate([np.array(r["counts"], np.int64) for r in rows]))
        tried = skipped = 0
        for m, r in enumerate(rows):
            for n in range(m, len(rows)):
                if (r["interval"] // tile, rows[n]["interval"] // tile) != (i, j):
                    continue
                tried += 1
                gap = np.maximum(0.0, np.maximum(box[m][0] - box[n][1], box[n][0] - box[m][1]).astype(np.float64))
                if (gap * gap).sum() > epsilon * epsilon + 1e-5:
                    skipped += 1
                    continue
                for s in range(0, len(x[m]), STRIP):
                    p, q = near_pairs(x[m][s : s + STRIP], x[n], b[m][s : s + STRIP], b[n], least)
                    p += s
                    if m == n:
                        p, q = p[p < q], q[p < q]
                    found.add(at[m] + p, at[n] + q)
        has = np.flatnonzero(found.links)
        roots = found.root[has]
        none = lambda v: pa.array([*([None] * len(has)), v], pa.int64())
        cols = [pa.array([*reps[has].tolist(), None], pa.int64()), pa.array([*found.links[has].tolist(), None], pa.int64()), pa.array([*reps[roots].tolist(), None], pa.int64()), none(tried), none(skipped)]
        return pa.table(cols, names=["rep", "links", "root", "tried", "skipped"])

    side = blocks.withColumn("t", F.floor(F.col("interval") / tile).cast("long"))
    left = tiles.join(side, F.col("i") == F.col("t"))
    right = tiles.where("i <> j").join(side, F.col("j") == F.col("t"))
    sent = left.unionByName(right).select("i", "j", "interval", "reps", "counts", "vectors")  # 2 * tile intervals at most in a group
    return sent.groupBy("i", "j").applyInArrow(run, "rep long, links long, root long, tried long, skipped long")


def pack(placed: DataFrame, kind: str) -> DataFrame:
    """Blocks ``(interval, reps, counts, vectors)``: the vectors of an interval, packed."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                members = sorted(r["members"], key=lambda m: m["rep"])
                packed = np.array([m["vector"] for m in members], kind).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["interval"]], pa.int64()), pa.array([[m["rep"] for m in members]], pa.list_(pa.int64())), pa.array([[m["n"] for m in members]], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                    names=["interval", "reps", "counts", "vectors"],
                )

    grouped = placed.groupBy("interval").agg(F.collect_list(F.struct("rep", "n", "vector")).alias("members"))  # INTERVAL rows at most
    return grouped.mapInArrow(run, "interval long, reps array<long>, counts array<long>, vectors binary")


def linked(reps: DataFrame, size: int, least: float, trace: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """``(rep, links, root)`` for the vectors ``(rep, n, vector)`` of one length: see ``join_tiles``."""
    kind = "f4" if reps.schema["vector"].dataType.simpleString() == "array<float>" else "f8"
    directions = principal(reps, size, DIMENSIONS)
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    placed = sequence(reps, directions, epsilon).withColumn("interval", F.floor(F.col("place") / INTERVAL).cast("long"))
    tiles = -(-reps.count() // (INTERVAL * TILE))
    corners = placed.select(F.floor(F.col("interval") / TILE).cast("long").alias("interval"), F.posexplode("projected").alias("d", "x")).groupBy("interval", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes = cut(corners.groupBy("interval").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("b")).select("interval", "b.low", "b.high"))
    pairs = interval_pairs(boxes, tiles, epsilon)
    found = cut(join_tiles(cut(pack(placed, kind)), pairs, directions, least, kind, TILE))
    if trace:
        trace("tiles", pairs)
        trace("intervals", found.where("rep is null").agg(F.sum("tried").alias("tried"), F.sum("skipped").alias("skipped")))
    return found.where("rep is not null").select("rep", "links", "root")


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding", trace: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """``vectors`` without their components, with ``n_links``, ``component_id`` and ``kept``.

    Two vectors of one length link if their cosine is at least ``least``; each length is joined by
    itself. Equal vectors are joined once, by their count, so a vector that fills a third of the table
    is one row of the join. Single and double precision components are taken as they are. Null,
    empty, zero and non-finite vectors and vectors with a null key link with nothing: their
    component is their own key. Repeated rows count as copies. An empty table gives an empty
    result; columns named as the made ones are replaced, all others kept, whatever their names.
    """
    made = ["n_links", "component_id", "kept"]
    keep = [c for c in vectors.columns if c not in made and c != column]
    return aside(vectors, (key, column), made, lambda v: _near_duplicates(v, least, key, column, trace)).select(*keep, *made)


def _near_duplicates(v: DataFrame, least: float, key: str, column: str, trace: Callable[[str, DataFrame], None] | None) -> DataFrame:
    keep = [c for c in v.columns if c != column]
    if v.schema[column].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.withColumn(column, F.col(column).cast("array<double>"))
    v = v.withColumnRenamed(column, "_v").withColumn("_ok", F.col(key).isNotNull() & usable(F.col("_v")))
    v = v.withColumn("_a", F.xxhash64("_v")).withColumn("_b", F.xxhash64("_v", F.lit(1)))
    groups = v.where("_ok").groupBy("_a", "_b").agg(F.min(key).alias("rep"), F.count("*").alias("n"), F.min("_v").alias("vector"))
    reps = cut(groups.select("_a", "_b", F.col("rep").cast("long"), "n", "vector", F.size("vector").alias("size")))
    found = None
    for r in sorted(reps.groupBy("size").count().where("count > 1").collect()):  # a row for each length
        links = linked(reps.where(F.col("size") == r["size"]).select("rep", "n", "vector"), r["size"], least, trace)
        found = links if found is None else found.unionByName(links)
    rest = v.where(~F.col("_ok")).withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col(key).cast("long"))
    own = reps.select("_a", "_b", "rep", "n")
    if found is None:
        by_rep = own.select("_a", "_b", (F.col("n") - 1).alias("n_links"), F.col("rep").alias("component_id"))
    else:
        links = found.groupBy("rep").agg(F.sum("links").alias("far"))
        component = connected_components(found, "rep", "root")
        by_rep = own.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
        by_rep = by_rep.select("_a", "_b", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = v.where("_ok").join(by_rep, ["_a", "_b"])
    both = known.select(*keep, "n_links", "component_id").unionByName(rest.select(*keep, "n_links", "component_id"))
    return both.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op9_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


#: Cosines of all pairs, then the smallest id each vector reaches.
OP9_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e,
    embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b from (select * from v where ok) a join (select * from v where ok) b
    on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9::double
), w as (
  select vec_id as node, vec_id as low from v union select l.b, w.low from w join l on l.a = w.node where w.low < l.b
), c as (
  select node, min(low) as component_id from w group by 1
)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, component_id, v.vec_id = component_id as kept from v join c on c.node = v.vec_id
"""
