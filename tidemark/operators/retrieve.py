"""Retrieval inside filtered views: exact and hashed top-k, fusion, attention, kNN residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.annotate import cosine, dot
from tidemark.session import cut

# Weights of the sources in the fused score, and sizes.
WEIGHTS = {"tan": 0.50, "emb": 0.35, "aux": 0.15}
POOL, TOP = 256, 16
#: Similarities that a task holds at a time, with a few arrays of their size.
SLAB = 1 << 19


class IncompatibleViewError(ValueError):
    """A candidate comes from another view than its query."""


def sufficiency(pool: DataFrame, views: DataFrame, view: str, least: int = 200) -> DataFrame:
    """Every view's size and whether it is too small to be used."""
    n = pool.groupBy(view).agg(F.count("*").alias("size"))
    return views.select(view).distinct().join(n, view, "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("insufficient", F.col("size") < least)


def usable_pool(pool: DataFrame, sizes: DataFrame, view: str) -> DataFrame:
    """The pool without the rows of insufficient views, whose queries so get an empty pool."""
    return pool.join(sizes.where("insufficient").select(view), view, "left_anti").select(*pool.columns)


def topk(queries: DataFrame, pool: DataFrame, view: str, k: int, kind: str = "cosine", q_block: int = 2_000, p_block: int = 8_000) -> DataFrame:
    """``(query_id, memory_id, sim, rank)``, exact, ties to the smaller memory id. A row is no neighbour of itself.

    ``queries``: ``query_id, vector, view``; ``pool``: ``memory_id, vector, view``. ``kind`` is cosine, Jaccard
    for 0/1 vectors, or hamming (less the distance over the bits) for packed codes. A view is
    cut into blocks by a hash of the ids; a pair of blocks is one matrix product that keeps k
    candidates a query; these are merged by a window. No task gets a whole view: the number of
    blocks follows its measured size.
    """
    return best_k(block_topk(queries, pool, [view], k, kind, q_block, p_block), k)


def best_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "memory_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(vectors: pd.Series, kind: str) -> np.ndarray:
    """The vectors as rows that ``_similarities`` multiplies: of length 1 for cosine, bits as 1 and -1 for hamming."""
    if kind == "hamming":
        bits = np.unpackbits(np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1), axis=1).astype(np.float32)
        bits *= 2
        bits -= 1
        return bits
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) if kind == "cosine" else x


def _similarities(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    s = a @ b.T
    if kind == "hamming":
        s = s.astype(np.float64) / 2 / a.shape[1] - 0.5
    elif kind == "jaccard":
        union = a.sum(1)[:, None] + b.sum(1)[None, :] - s
        s = np.where(union > 0, s / np.maximum(union, 1), 0.0)
    return np.round(s, 12)


def _best_of_block(left: pd.DataFrame, right: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    """The ``k`` best rows of ``right`` for each of ``left``, slab by slab of queries."""
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "memory_id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
    right = right.sort_values("memory_id")
    ids, b = right["memory_id"].to_numpy(), _block(right["vector"], kind)
    found = []
    for at in range(0, len(left), max(1, SLAB // len(right))):
        part = left.iloc[at : at + max(1, SLAB // len(right))]
        q, s = part["query_id"].to_numpy(), _similarities(_block(part["vector"], kind), b, kind)
        s[q[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        sim = np.take_along_axis(s, best, axis=1).ravel()
        seen = np.isfinite(sim)
        found.append((np.repeat(q, best.shape[1])[seen], ids[best.ravel()[seen]], sim[seen]))
    return pd.DataFrame(dict(zip(("query_id", "memory_id", "sim"), (np.concatenate(c) for c in zip(*found)))))


def block_topk(queries: DataFrame, pool: DataFrame, by: list[str], k: int, kind: str = "cosine", q_block: int = 2_000, p_block: int = 8_000) -> DataFrame:
    """``(query_id, memory_id, sim)``: each query's ``k`` best of every block of the pool that shares its ``by``.

    Each group of ``by`` is cut into as many blocks as its own counted rows ask for. A task takes a block's queries slab by
    slab, so that it holds ``SLAB`` similarities at a time whatever the block's size.
    """
    own = [F.col(c).alias(c) for c in by]  # columns of their own, as both sides may come from one table
    blocks = lambda df, size, name: df.select(*own).groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = cut(blocks(queries, q_block, "_nq").join(blocks(pool, p_block, "_np"), by))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = grid.select(*own, "_nq", "_np")
    q = queries.join(grid, by).withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int")).withColumn("_p", every("_np"))
    p = pool.join(grid, by).withColumn("_p", F.pmod(F.xxhash64("memory_id"), F.col("_np")).cast("int")).withColumn("_q", every("_nq"))
    key = [*by, "_q", "_p"]
    # both sides are dealt into the same number of partitions here, which adaptive execution keeps
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, p = (x.select(*own, "_q", "_p", F.col(i).alias(i), F.col("vector").alias("vector")).repartition(n, *key) for x, i in ((q, "query_id"), (p, "memory_id")))
    return q.groupBy(*key).cogroup(p.groupBy(*key)).applyInPandas(lambda left, right: _best_of_block(left, right, k, kind), "query_id long, memory_id long, sim double")


def plane_codes(rows: DataFrame, vector: str, planes: np.ndarray, centre: float = 0.0) -> DataFrame:
    """Adds ``code``: the packed signs of a vector's products, less ``centre``, with random hyperplanes (a row of ``planes`` each)."""
    names = [*rows.columns, "code"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", code binary"

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(vector).to_pylist(), dtype=float)
                codes = np.packbits((x - centre) @ planes.T >= 0, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def lsh_topk(queries: DataFrame, pool: DataFrame, view: str, k: int, kind: str = "jaccard", planes: int = 1024, oversample: int = 8, seed: int = 7) -> DataFrame:
    """``(query_id, memory_id, sim, rank)``: the ``oversample * k`` nearest codes in Hamming distance, ranked again
    by the exact similarity down to ``k``.

    A scan of all codes, ``planes / 8`` bytes each: less than the vectors only if these are longer than ``planes / 64``
    doubles. ``cells.cell_topk`` looks at part of the pool instead. Recall falls with fewer planes; it is
    measured in the tests against ``topk``.
    """
    size = pool.select(F.max(F.size("vector"))).first()[0] or 1
    p = np.random.default_rng(seed).standard_normal((planes, size))
    centre = 0.5 if kind == "jaccard" else 0.0  # planes through the middle of the cube of 0/1 vectors
    q, m = cut(plane_codes(queries, "vector", p, centre)), cut(plane_codes(pool, "vector", p, centre))
    near = topk(q.select("query_id", view, F.col("code").alias("vector")), m.select("memory_id", view, F.col("code").alias("vector")), view, oversample * k, "hamming")
    both = near.select("query_id", "memory_id").join(q.select("query_id", F.col("vector").alias("_q")), "query_id").join(m.select("memory_id", F.col("vector").alias("_m")), "memory_id")
    inter, total = dot(F.col("_q"), F.col("_m")), lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    union = total(F.col("_q")) + total(F.col("_m")) - inter
    sim = F.when(union > 0, inter / union).otherwise(0.0) if kind == "jaccard" else cosine(F.col("_q"), F.col("_m"))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "memory_id")
    return both.select("query_id", "memory_id", F.round(sim, 12).alias("sim")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(candidates: DataFrame, k: int = POOL) -> DataFrame:
    """``candidates`` with ``s_tan, s_emb, s_aux`` (null: 0), the fused score and ``pool_rank``."""
    score = sum((F.coalesce(F.col(f"s_{n}"), F.lit(0.0)) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("stage1"), "memory_id")
    return candidates.withColumn("stage1", F.round(score, 12)).withColumn("pool_rank", F.row_number().over(w)).where(F.col("pool_rank") <= k)


def assert_compatible(candidates: DataFrame, q_view: str, m_view: str) -> None:
    """Raises if any candidate's view is not its query's."""
    n = candidates.where(~F.col(q_view).eqNullSafe(F.col(m_view))).count()
    if n:
        raise IncompatibleViewError(f"{n} candidates")


def rank_scalars(pool: DataFrame, score: str = "stage1", rank: str | None = None) -> DataFrame:
    """Place from 0 to 1 and z-score (sample deviation, at least 1e-6) within a query.

    Places follow the column ``rank`` if it is given, else the score and then the memory id: a score rounded since
    the pool was ranked has ties that its ranks do not have.
    """
    q = Window.partitionBy("query_id")
    order = [F.col(rank)] if rank else [F.desc(score), F.col("memory_id")]
    n, place = F.count("*").over(q), F.row_number().over(q.orderBy(*order)) - 1
    z = (F.col(score) - F.avg(score).over(q)) / F.greatest(F.coalesce(F.stddev_samp(score).over(q), F.lit(0.0)), F.lit(1e-6))
    return pool.withColumn("rank_norm", F.when(n > 1, place / (n - 1)).otherwise(0.0)).withColumn("score_z", F.when(n > 1, z).otherwise(0.0))


def candidate_meta(pool: DataFrame, train: DataFrame, flag: str = "flag", records: str = "n_records", y: str = "y") -> DataFrame:
    """``pool`` with ``is_censored``, ``log_records``, ``y_std`` (by the training rows' mean and sample deviation, at
    least 1e-6; 0 without a label) and ``has_label``."""
    one = train.agg(F.avg(y).alias("_mu"), F.greatest(F.coalesce(F.stddev_samp(y), F.lit(0.0)), F.lit(1e-6)).alias("_sd"))
    out = pool.crossJoin(F.broadcast(one))  # one row
    out = out.withColumn("is_censored", (F.coalesce(F.col(flag), F.lit("none")) != "none").cast("int")).withColumn("log_records", F.log1p(F.coalesce(F.col(records), F.lit(0)).cast("double")))
    out = out.withColumn("has_label", F.col(y).isNotNull().cast("int"))
    return out.withColumn("y_std", F.coalesce((F.col(y) - F.col("_mu")) / F.col("_sd"), F.lit(0.0))).drop("_mu", "_sd")


def attention(rows: DataFrame, score: str, tau: float, by: str = "query_id") -> DataFrame:
    """Softmax of scores within a query, as ``alpha``."""
    w = Window.partitionBy(by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / tau)
    return rows.withColumn("_e", e).withColumn("alpha", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def knn_residual(queries: DataFrame, neighbours: DataFrame, tau: float = 0.1) -> DataFrame:
    """Softmax-weighted neighbour label less the base prediction; 0 without neighbours."""
    pooled = attention(neighbours, "sim", tau).groupBy("query_id").agg(F.sum(F.col("alpha") * F.col("y")).alias("_m"))
    return queries.join(pooled, "query_id", "left").withColumn("residual", F.coalesce(F.col("_m") - F.col("base"), F.lit(0.0))).drop("_m")


def listwise_loss(rows: DataFrame, score: str, target: str, by: str = "query_id") -> DataFrame:
    """Cross-entropy of two softmaxes within each query."""
    w = Window.partitionBy(by)
    lse = lambda c: F.log(F.sum(F.exp(F.col(c) - F.col(f"_m_{c}"))).over(w)) + F.col(f"_m_{c}")
    r = rows.withColumn(f"_m_{score}", F.max(score).over(w)).withColumn(f"_m_{target}", F.max(target).over(w))
    r = r.withColumn("_ls", F.col(score) - lse(score)).withColumn("_lt", F.col(target) - lse(target))
    return r.groupBy(by).agg((-F.sum(F.exp("_lt") * F.col("_ls"))).alias("loss"))


def pairwise_loss(rows: DataFrame, score: str, target: str, margin: float = 0.0, by: str = "query_id", key: str = "memory_id") -> DataFrame:
    """Mean softplus of the margin less the score gap, over a query's ordered pairs; pools are bounded."""
    a, b = (rows.select(F.col(by), F.col(score).alias(f"s{i}"), F.col(target).alias(f"t{i}")) for i in (1, 2))
    pairs = a.join(b, by).where("t1 > t2")
    x = F.lit(margin) - (F.col("s1") - F.col("s2"))
    return pairs.groupBy(by).agg(F.avg(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("loss"), F.count("*").alias("pairs"))


class FeatureOrderError(ValueError):
    """Feature columns are missing or stand in another order."""


# The support features in their contractual order.
FEATURES = [
    "alpha_entropy", "alpha_ess", "score_margin_norm", "tanimoto_max", "tanimoto_mean", "tanimoto_std", "tanimoto_top1_top2_gap",
    "emb_sim_max", "emb_sim_mean", "emb_sim_std", "rank_zscore_q50", "rank_zscore_q75", "rank_zscore_q90",
    "match_conf_max", "match_conf_mean", "match_conf_std", "neighbor_label_variance", "neighbor_label_mad", "neighbor_label_range",
    "unique_scaffold_ratio", "pairwise_tanimoto_mean", "pairwise_tanimoto_std", "assay_compatible_ratio", "activity_cliff_score",
    "var_ratio_k_over_k0", "dropped_high_tanimoto_cnt", "base_ensemble_variance", "base_aleatoric_sigma",
]


def feature_matrix(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """H2: ``(key, features)``, an array in the contractual order. Columns in another order are an error."""
    found = [c for c in rows.columns if c in FEATURES]
    if found != FEATURES:
        raise FeatureOrderError(next((f"{a} for {b}" for a, b in zip(found, FEATURES) if a != b), f"{len(found)} of {len(FEATURES)} features"))
    return rows.select(key, F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("features"))


_PAIRS = "query_id long, pairwise_tanimoto_mean double, pairwise_tanimoto_std double, activity_cliff_score double"


def _pair_features(part: pd.DataFrame, cliff_sim: float, cliff_gap: float) -> pd.DataFrame:
    """Over all pairs of one query's pool: Jaccard among its top, and the share of activity cliffs times their mean gap."""
    part = part.sort_values("memory_id")
    sets = [np.unique(x) if x is not None else np.empty(0) for x in part["items"]]
    known = np.unique(np.concatenate([*sets, np.empty(0)]))
    held = np.zeros((len(sets), len(known)))
    for row, s in zip(held, sets):
        row[np.searchsorted(known, s)] = 1
    inter, size = held @ held.T, held.sum(1)
    union = size[:, None] + size[None, :] - inter
    i, j = np.triu_indices(len(sets), 1)
    sim = np.where(union > 0, inter / np.maximum(union, 1), 0.0)[i, j]
    y, top = part["y"].to_numpy(float), part["is_topk"].fillna(False).to_numpy(bool)
    gap = np.abs(y[i] - y[j])
    near = sim >= cliff_sim
    cliff, sure = near & (gap >= cliff_gap), ~(near & np.isnan(gap))
    tops = sim[top[i] & top[j]]
    score = cliff[sure].mean() * (gap[cliff].mean() if cliff.any() else 0.0) if sure.any() else None
    return pd.DataFrame({"query_id": part["query_id"].iloc[:1], "pairwise_tanimoto_mean": [tops.mean() if len(tops) else None], "pairwise_tanimoto_std": [tops.std() if len(tops) else None], "activity_cliff_score": [score]})


def support_features(pool: DataFrame, base: DataFrame, ensemble: bool = True, cliff_sim: float = 0.60, cliff_gap: float = 1.0, high: float = 0.70) -> DataFrame:
    """H1: the 28 support features of each query, and the names of those that are ``blocked``.

    ``pool``: ``query_id, memory_id, score, s_tan, s_emb, match_conf, alpha, y, family_id, assay_compatible,
    items, is_topk``; ``base``: ``query_id, base_ensemble_variance, base_aleatoric_sigma``. Conflict features
    use the whole pool, support features its top. Pairs are looked at within a query only, in one call, as its pool
    is bounded by ``POOL``.
    """
    q = ["query_id"]
    pool = cut(pool)  # read six times
    top = pool.where("is_topk")
    w = Window.partitionBy("query_id")
    a = top.withColumn("_a", F.col("alpha") / F.greatest(F.sum("alpha").over(w), F.lit(1e-12)))
    ordered = lambda c: F.sort_array(F.collect_list(c), asc=False)
    k = a.groupBy(*q).agg(
        F.count("*").alias("_k"),
        (-F.sum(F.col("_a") * F.log(F.col("_a") + 1e-12))).alias("alpha_entropy"),
        (1.0 / F.greatest(F.sum(F.col("_a") * F.col("_a")), F.lit(1e-12))).alias("alpha_ess"),
        ordered("score").alias("_s"),
        ordered("s_tan").alias("_t"),
        *[f(c).alias(f"{n}_{x}") for c, n in (("s_tan", "tanimoto"), ("s_emb", "emb_sim"), ("match_conf", "match_conf")) for f, x in ((F.max, "max"), (F.avg, "mean"), (F.stddev_pop, "std"))],
        (F.countDistinct("family_id") / F.count("*")).alias("unique_scaffold_ratio"),
        F.coalesce(F.avg("assay_compatible"), F.lit(1.0)).alias("assay_compatible_ratio"),
        F.var_pop("y").alias("_vk"),
        F.count_if(F.col("s_tan") >= high).alias("_hk"),
    )
    two = F.col("_k") > 1
    k = k.withColumn("score_margin_norm", F.when(two, (F.col("_s")[0] - F.col("_s")[1]) / (F.col("_s")[0] - F.element_at("_s", -1) + 1e-6)).otherwise(0.0))
    k = k.withColumn("tanimoto_top1_top2_gap", F.when(two, F.col("_t")[0] - F.col("_t")[1]).otherwise(0.0)).drop("_s", "_t")
    k0 = pool.groupBy(*q).agg(
        F.avg("score").alias("_m"), F.stddev_pop("score").alias("_sd"), F.percentile("score", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("_p"), F.count("*").alias("_k0"),
        F.var_pop("y").alias("neighbor_label_variance"), (F.max("y") - F.min("y")).alias("neighbor_label_range"), F.percentile("y", F.lit(0.5)).alias("_med"), F.count_if(F.col("s_tan") >= high).alias("_h0"),
    )
    for i, n in enumerate((50, 75, 90)):
        k0 = k0.withColumn(f"rank_zscore_q{n}", F.when(F.col("_k0") > 1, (F.col("_p")[i] - F.col("_m")) / F.greatest("_sd", F.lit(1e-9))).otherwise(0.0))
    mad = pool.join(k0.select(*q, "_med"), q).groupBy(*q).agg(F.percentile(F.abs(F.col("y") - F.col("_med")), F.lit(0.5)).alias("neighbor_label_mad"))


    pairs = pool.select("query_id", "memory_id", "items", "y", "is_topk").groupBy("query_id").applyInPandas(lambda part: _pair_features(part, cliff_sim, cliff_gap), _PAIRS)  # POOL rows
    out = k0.join(k, q).join(mad, q).join(pairs, q, "left").join(base, q)
    out = out.withColumn("var_ratio_k_over_k0", F.when(F.col("neighbor_label_variance") > 1e-12, F.col("_vk") / F.col("neighbor_label_variance")).otherwise(0.0))
    out = out.withColumn("dropped_high_tanimoto_cnt", F.greatest(F.col("_h0") - F.col("_hk"), F.lit(0)).cast("double"))
    if not ensemble:
        out = out.withColumn("base_ensemble_variance", F.lit(0.0))
    blocked = F.array(*([] if ensemble else [F.lit("base_ensemble_variance")])).cast("array<string>")
    return out.select("query_id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES], blocked.alias("blocked"))
