"""Leakage: purging a pool by a blacklist, per-view filters, and assertions that really run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.filters import bloom, may_hold
from tidemark.functions.texts import hash_windows, with_windows
from tidemark.operators.ranking import cumulative
from tidemark.session import cut, written

KEYS = ["skeleton", "core", "normal", "family"]


class LeakageError(ValueError):
    """Queries and pool share a key."""


def purge_status(pool: DataFrame, blacklist: DataFrame, exact: str = "exact_key", prefix: str = "prefix_key") -> DataFrame:
    """``pool`` with ``status``: ``exact`` or ``prefix`` if the blacklist holds the key, exact first, else ``kept``.

    Blank keys match nothing. Both lookups are equi-joins on distinct keys, so nothing is repeated.
    """

    def listed(c: str, flag: str) -> DataFrame:
        return blacklist.select(F.trim(c).alias(f"_{c}")).where(F.col(f"_{c}") != "").distinct().withColumn(flag, F.lit(True))

    marked = pool.withColumn(f"_{exact}", F.trim(exact)).withColumn(f"_{prefix}", F.trim(prefix))
    marked = marked.join(listed(exact, "_e"), f"_{exact}", "left").join(listed(prefix, "_p"), f"_{prefix}", "left")
    return marked.withColumn("status", F.when(F.col("_e"), "exact").when(F.col("_p"), "prefix").otherwise("kept")).drop("_e", "_p", f"_{exact}", f"_{prefix}")


def count_shared(pool: DataFrame, blacklist: DataFrame, text: str = "text", width: int = 8, small: int = 1_000_000) -> DataFrame:
    """``pool`` with ``n_shared``: how many distinct windows of ``width`` words a row's text shares with the blacklist's
    texts. It is counted row by row, so ids may repeat or be null; null texts share none.

    Windows are 64-bit hashes. Up to ``small`` distinct ones, counted first, go to the tasks that scan
    the pool (8 bytes each), which count them there. Of a larger blacklist the tasks get a Bloom filter of bounded size: what it
    lets through is kept with the row, and only these few hits are met with the blacklist in a shuffle join.
    """
    held = cut(with_windows(blacklist.select(text), text, width, "_w").select(F.explode("_w").alias("_w")).distinct())
    n = held.count()
    exact = n <= small
    listed = np.sort(held.toPandas()["_w"].to_numpy(np.int64)) if exact else bloom(held, "_w", n)
    names = [c for c in pool.columns if c != "n_shared"]
    made = ("n_shared", "long") if exact else ("_hits", "array<long>")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                windows = hash_windows(part.column(text).to_pylist(), width)
                if exact:
                    of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
                    every = np.concatenate([*windows, np.empty(0, np.int64)])
                    place = np.minimum(np.searchsorted(listed, every), max(0, len(listed) - 1))
                    hit = listed[place] == every if len(listed) else np.zeros(len(every), bool)
                    found = pa.array(np.bincount(of[hit], minlength=len(windows)).astype(np.int64))
                else:
                    found = pa.array([w[may_hold(listed, w)] for w in windows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], found], names=[*names, made[0]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.select(*names).schema)
    scanned = pool.select(*names).mapInArrow(run, f"{schema}, {made[0]} {made[1]}")
    if exact:
        return scanned
    scanned = written(scanned.withColumn("_row", F.monotonically_increasing_id()))
    hits = scanned.select("_row", F.explode("_hits").alias("_w")).join(held, "_w", "left_semi").groupBy("_row").agg(F.count("*").alias("n_shared"))
    return scanned.drop("_hits").join(hits, "_row", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long"))).drop("_row")


def shared_passages(pool: DataFrame, blacklist: DataFrame, key: str, text: str = "text", width: int = 8, small: int = 1_000_000) -> DataFrame:
    """``(key, n_shared)`` by ``count_shared``; texts that share none have no row, and rows of one key are added up."""
    return count_shared(pool.select(key, text), blacklist, text, width, small).where("n_shared > 0").groupBy(key).agg(F.sum("n_shared").alias("n_shared"))


def purge_texts(pool: DataFrame, blacklist: DataFrame, text: str = "text", width: int = 8, small: int = 1_000_000) -> DataFrame:
    """``pool`` with ``n_shared`` and ``status``: ``exact`` if the blacklist holds the whole text, ``passage`` if it
    shares a window of ``width`` words, else ``kept``. Null texts match nothing; ids play no part."""
    exact = blacklist.select(F.md5(text).alias("_x")).where("_x is not null").distinct().withColumn("_e", F.lit(True))
    marked = count_shared(pool, blacklist, text, width, small).withColumn("_x", F.md5(text)).join(exact, "_x", "left")
    return marked.withColumn("status", F.when(F.col("_e"), "exact").when(F.col("n_shared") > 0, "passage").otherwise("kept")).drop("_x", "_e")


def purge_report(status: DataFrame, universe: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Kept and dropped rows and drop rate of every entity of the universe, those without rows too."""
    n = status.groupBy(entity).agg(F.count_if(F.col("status") == "kept").alias("kept"), F.count_if(F.col("status") != "kept").alias("dropped"))
    out = universe.select(entity).distinct().join(n, entity, "left").select(entity, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "dropped")])
    total = F.col("kept") + F.col("dropped")
    return out.withColumn("rate", F.when(total > 0, F.col("dropped") / total).otherwise(0.0))


def purge_sizes(report: DataFrame) -> DataFrame:
    """Over the entities of a report: their number, the smallest and upper median of kept rows,
    and how many have none (upper median: the element at index ``floor(n / 2)`` of the sorted sizes)."""
    per = report.groupBy("kept").agg(F.count("*").alias("_n"))
    c = cumulative(per, "kept", ["_n"]).crossJoin(F.broadcast(per.agg(F.sum("_n").alias("_all"))))  # a row for each size
    upper = c.agg(F.min(F.when(F.col("_n_upto") > F.floor(F.col("_all") / 2), F.col("kept"))).alias("upper_median"))
    one = report.agg(F.count("*").alias("entities"), F.min("kept").alias("smallest"), F.count_if(F.col("kept") == 0).alias("zero"))
    return one.crossJoin(F.broadcast(upper))


def membership(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether a row's key is among the keys; false for none."""
    known = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return rows.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def visible(pool: DataFrame, unit_split: DataFrame, split: str, unit: str = "unit_id") -> DataFrame:
    """Pool rows whose unit is not of the split under evaluation. Units without queries stay visible."""
    return pool.join(unit_split.where(F.col("split") == split).select(unit).distinct(), unit, "left_anti")


def unpivot_keys(rows: DataFrame, keep: list[str], keys: list[str]) -> DataFrame:
    """Each row's non-blank keys as ``(kind, value)`` rows."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias("value")) for k in keys])
    return rows.select(*keep, F.explode(each).alias("_k")).select(*keep, "_k.*").where("value is not null")


def leaking(pool: DataFrame, queries: DataFrame, pool_id: str, view: list[str], keys: list[str]) -> DataFrame:
    """Ids of pool rows that share any key with a query of the same view. One equi-join, no disjunction."""
    held = unpivot_keys(queries, view, keys).distinct()
    return unpivot_keys(pool, [pool_id, *view], keys).join(held, [*view, "kind", "value"], "left_semi").select(pool_id).distinct()


def shared_keys(queries: DataFrame, pool: DataFrame, keys: list[str], examples: int = 10) -> DataFrame:
    """For each kind of key, how many values both sides have, and the first of them."""
    a, b = (unpivot_keys(x, [], keys).distinct() for x in (queries, pool))
    both = a.join(b, ["kind", "value"], "left_semi")
    n = both.groupBy("kind").agg(F.count("*").alias("n"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("value"))).where(F.col("r") <= examples)
    return n.join(top.groupBy("kind").agg(F.array_sort(F.collect_list("value")).alias("examples")), "kind")


def assert_zero_overlap(queries: DataFrame, pool: DataFrame, keys: list[str]) -> None:
    """Raises if any key is shared; an action."""
    found = shared_keys(queries, pool, keys).orderBy("kind").collect()
    if found:
        raise LeakageError("; ".join(f"{r['kind']}: {r['n']} shared, such as {r['examples']}" for r in found))


def key_overlap(queries: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Share of the queries' distinct keys that the pool has."""
    q = queries.select(key).where(F.col(key).isNotNull()).distinct()
    return membership(q, pool, key, "_in").agg(F.count("*").alias("n"), F.count_if("_in").alias("shared"), F.avg(F.col("_in").cast("double")).alias("rate"))


def overlap_gate(queries: DataFrame, pool: DataFrame, key: str, most: float = 0.05) -> DataFrame:
    """The share of the queries' distinct keys that the pool has, and whether it is at most ``most``."""
    return key_overlap(queries, pool, key).withColumn("passed", F.coalesce(F.col("rate") <= most, F.lit(True)))


def audit(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many rows have each flag, and the percentage, in one pass."""
    aggs = [F.count("*").alias("_n")] + [F.count_if(c).alias(k) for k, c in flags.items()]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n"), F.round(100.0 * F.col(k) / F.col("_n"), 1).alias("percent")) for k in flags])
    return one.select(F.explode(each).alias("x")).select("x.*")
