"""A recall index: the pool in cells around k-means centres, of which a query probes the nearest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.retrieve import best_k, block_topk, topk
from tidemark.session import cut, written

#: Cells, at most; rows of the sample that centres are fitted on, to a cell; queries that the probes are set by.
CELLS, PER_CELL, TRIED = 4_096, 256, 200
_RANGE = 1 << 30


@dataclass(frozen=True)
class CellIndex:
    """``rows``: the pool with its ``cell``, a written table. ``centres`` are unit rows, ``mean`` is taken off a vector before its
    direction is compared with them, ``probes`` is how many cells a query looks at."""

    rows: DataFrame
    view: str
    kind: str
    centres: np.ndarray
    mean: np.ndarray
    probes: int


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _directions(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    x = x - mean
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _sums(rows: DataFrame, centres: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and summed directions of each cell; a task sends one row a cell."""
    k, d = centres.shape

    def run(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, d))
        for b in batches:
            if b.num_rows:
                x = _directions(_matrix(b.column("vector")), mean)
                cell = np.argmax(x @ centres.T, axis=1)
                n += np.bincount(cell, minlength=k)
                np.add.at(s, cell, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(s[some]), pa.list_(pa.float64()))], names=["cell", "n", "s"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "n": [part["n"].sum()], "s": [np.sum(part["s"].to_list(), axis=0)]})

    n, s = np.zeros(k, np.int64), np.zeros((k, d))
    for r in rows.select("vector").mapInArrow(run, "cell long, n long, s array<double>").groupBy("cell").applyInPandas(add, "cell long, n long, s array<double>").collect():
        n[r["cell"]], s[r["cell"]] = r["n"], r["s"]
    return n, s


def fit_centres(pool: DataFrame, cells: int, kind: str, rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``(centres, mean)`` by k-means on directions, over a sample of about ``PER_CELL`` rows a cell, chosen by a hash of the id.

    A round is one pass over the sample in which tasks sum the directions of each cell; the driver gets ``cells`` rows. A cell
    that gets empty takes the place of half of the largest. The mean is 0 for cosine.
    """
    n = pool.count()
    place = F.xxhash64(F.col("memory_id"), F.lit(seed))
    sample = cut(pool.where(F.pmod(place, F.lit(_RANGE)) < int(_RANGE * min(1.0, cells * PER_CELL / max(n, 1)))).select("vector", place.alias("place")))
    first = np.array([r["vector"] for r in sample.orderBy("place").limit(cells).collect()], float)
    if not len(first):
        return np.zeros((0, 0)), np.zeros(0)
    mean = np.zeros(first.shape[1])
    if kind == "jaccard":
        means = [F.avg(F.col("vector")[i]).alias(f"m{i}") for i in range(first.shape[1])]
        mean = np.array(sample.agg(*means).first(), float)
    centres = _directions(first, mean)
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        size, total = _sums(sample, centres, mean)
        for empty in np.flatnonzero(size == 0):
            big = int(np.argmax(size))
            total[empty] = total[big] + r.standard_normal(total.shape[1]) * np.abs(total[big]).max() * 1e-3
            size[empty] = size[big] = size[big] // 2
        moved = _directions(total, 0.0)
        settled = np.abs(moved - centres).max() < 1e-3
        centres = moved
        if settled:
            break
    return centres, mean


def nearest_cells(rows: DataFrame, index: CellIndex, probes: int) -> DataFrame:
    """``rows`` with ``cell``, once for each of its ``probes`` nearest cells, and their place ``nearness`` from 1."""
    names = [*rows.columns, "cell", "nearness"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, nearness int"
    centres, mean = index.centres, index.mean
    probes = min(probes, len(centres))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                near = -(_directions(_matrix(b.column("vector")), mean) @ centres.T)
                order = np.argsort(near, axis=1, kind="stable")[:, :probes] if probes < len(centres) else np.argsort(near, axis=1, kind="stable")
                row = pa.array(np.repeat(np.arange(b.num_rows), probes))
                cols = [c.take(row) for c in b.columns] + [pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, probes + 1, dtype=np.int32), b.num_rows))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)


def build_index(pool: DataFrame, view: str, k: int, kind: str = "cosine", cells: int | None = None, target: float = 0.95, seed: int = 7) -> CellIndex:
    """An index of ``pool`` (``memory_id, vector``, and the column named by ``view``).

    The number of cells is the root of the rows unless given, ``CELLS`` at most. Every row is indexed, under the cell of its nearest centre. Of the
    pool's rows, ``TRIED`` chosen by a hash are searched exactly; the fewest cells that hold a share of ``target`` of all their
    ``k`` neighbours are probed by every query. So recall follows the data: where neighbours share cells few are looked at, and
    where vectors are random most are.
    """
    n = pool.count()
    cells = min(CELLS, cells or max(1, round(n**0.5)))
    centres, mean = fit_centres(pool, cells, kind, seed=seed)
    index = CellIndex(pool.limit(0), view, kind, centres, mean, 1)
    if not len(centres):
        return index
    rows = written(nearest_cells(pool.select("memory_id", view, "vector"), index, 1).drop("nearness"))
    tried = rows.where(F.pmod(F.xxhash64("memory_id", F.lit(seed + 1)), F.lit(_RANGE)) < int(_RANGE * min(1.0, TRIED / n)))
    tried = cut(tried.select(F.col("memory_id").alias("query_id"), view, "vector"))
    exact = topk(tried, rows.select("memory_id", view, "vector"), view, k, kind)
    order = nearest_cells(tried.select("query_id", "vector"), index, len(centres)).select("query_id", "cell", "nearness")
    place = exact.join(rows.select("memory_id", "cell"), "memory_id").join(order, ["query_id", "cell"]).groupBy("nearness").agg(F.count("*").alias("n")).orderBy("nearness").toPandas()
    share = place["n"].cumsum() / max(1, place["n"].sum())
    probes = int(place["nearness"][share >= target].iloc[0]) if len(place) else len(centres)
    return CellIndex(rows, view, kind, centres, mean, probes)


def cell_topk(queries: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """``(query_id, memory_id, sim, rank)``: the ``k`` best of the cells that a query probes, by the exact similarity, ties to
    the smaller memory id. Cells are searched block by block, as many blocks as each cell's rows ask for."""
    if not len(index.centres):
        return queries.limit(0).select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("memory_id"), F.lit(0.0).alias("sim"), F.lit(0).alias("rank"))
    probed = nearest_cells(queries.select("query_id", index.view, "vector"), index, index.probes).drop("nearness")
    return best_k(block_topk(cut(probed), index.rows, [index.view, "cell"], k, index.kind), k)


def compared(queries: DataFrame, index: CellIndex) -> float:
    """The share of all pairs of queries and rows of their view that a search compares."""
    probed = nearest_cells(queries.select("query_id", index.view, "vector"), index, index.probes)
    size = index.rows.groupBy(index.view, "cell").agg(F.count("*").alias("n"))
    met = probed.join(size, [index.view, "cell"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = queries.join(size.groupBy(index.view).agg(F.sum("n").alias("n")), index.view).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return met / max(1, whole)
