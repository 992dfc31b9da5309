"""Small models: fitted from aggregates or by Spark ML, applied as expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip_zscore
from tidemark.operators.bootstrap import replicate_sums
from tidemark.operators.splits import group_folds, out_of_fold
from tidemark.operators.ranking import order_statistics
from tidemark.operators.stats import auroc
from tidemark.session import written


class TooFewRowsError(ValueError):
    """Fewer rows than dimensions are to be fitted."""


def mean_predictor(train: DataFrame, entity: str, y: str) -> DataFrame:
    """``(entity, mean)`` and the mean of all rows under a null entity."""
    return train.groupBy(entity).agg(F.avg(y).alias("_mean")).unionByName(train.agg(F.lit(None).cast("string").alias(entity), F.avg(y).alias("_mean")))


def median_predictor(train: DataFrame, entity: str, y: str) -> DataFrame:
    """J1 with medians: ``(entity, _mean)`` and that of all rows under a null entity, by ordered value counts."""
    rows = train.where(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias(entity), y)
    each = order_statistics(rows, [entity], y, {"_mean": ("linear", 0.5)}).select(entity, "_mean")
    every = order_statistics(train.select(F.lit(None).cast("string").alias(entity), y), [entity], y, {"_mean": ("linear", 0.5)}).select(entity, "_mean")
    return each.unionByName(every)


def mandatory_baselines(rows: DataFrame, splits: DataFrame, key: str, entity: str, y: str, features: list[str], trees: int = 500, seed: int = 7) -> DataFrame:
    """``(entity_id, y, method, pred)`` on the test rows, of the entity mean and of a random forest, both fitted on
    all rows that are not test. The split column is joined by key, never taken from the rows. The joined rows are written, as the fits read
    them many times; a row's bootstrap weights go by a hash of all its columns."""
    joined = rows.drop("split").join(splits.select(key, "split"), key)
    joined = written(joined.select(F.xxhash64(*joined.columns).alias("_k"), *dict.fromkeys([entity, y, *features]), "split"))
    train, test = joined.where("split <> 'test'"), joined.where("split = 'test'")
    mean = apply_mean(test, mean_predictor(train, entity, y), entity).select(F.col(entity).alias("entity_id"), y, F.lit("mean").alias("method"), F.col("mean_pred").alias("pred"))
    grown = forest(train, test, features, y, trees, seed, "_k").select(F.col(entity).alias("entity_id"), y, F.lit("forest").alias("method"), F.col("forest_pred").alias("pred"))
    return mean.unionByName(grown)


def apply_mean(rows: DataFrame, fitted: DataFrame, entity: str) -> DataFrame:
    """``rows`` with ``mean_pred``; unseen entities get the mean of all."""
    every = fitted.where(F.col(entity).isNull()).select(F.col("_mean").alias("_all"))
    return rows.join(fitted.where(F.col(entity).isNotNull()), entity, "left").crossJoin(F.broadcast(every)).withColumn("mean_pred", F.coalesce("_mean", "_all")).drop("_mean", "_all")


def standardizer(train: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, mean, std, dead)``; a deviation of 1e-6 or less counts as 1 and is dead."""
    one = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns])
    long = one.select(F.explode(each).alias("x")).select("x.*").withColumn("dead", F.coalesce(F.col("std") <= 1e-6, F.lit(True)))
    return long.withColumn("std", F.when(F.col("dead"), 1.0).otherwise(F.col("std")))


def standardize(rows: DataFrame, fitted: DataFrame, most: float = 5.0) -> DataFrame:
    """B12 with the values of ``standardizer``."""
    for r in fitted.collect():  # a row for each column
        rows = rows.withColumn(r["name"], clip_zscore(F.col(r["name"]), r["mean"], r["std"], most))
    return rows


def gram(rows: DataFrame, vector: str, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sum and second moments of a vector column, summed in the tasks."""

    def run(batches):
        n, s, ss = 0.0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").to_pylist(), dtype=float)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([[n, *s, *ss.ravel()]], pa.list_(pa.float64()))], names=["sums"])

    sums = rows.select(F.col(vector).alias("v")).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(1 + size + size * size)
    for r in sums.collect():
        flat[r["i"]] = r["x"]
    return flat[0], flat[1 : size + 1], flat[size + 1 :].reshape(size, size)


@dataclass(frozen=True)
class Whitening:
    mean: np.ndarray
    axes: np.ndarray
    scale: np.ndarray
    explained: float


def fit_whitening(train: DataFrame, vector: str, k: int) -> Whitening:
    """Leading principal axes of the training rows, scaled to unit variance."""
    size = train.select(F.max(F.size(vector))).first()[0] or 0
    n, s, ss = gram(train, vector, size)
    if n < k or n < 2:
        raise TooFewRowsError(f"{n:.0f} rows for {k} dimensions")
    mean = s / n
    values, axes = np.linalg.eigh((ss - n * np.outer(mean, mean)) / (n - 1))
    values, axes = values[::-1], axes[:, ::-1]
    return Whitening(mean, axes[:, :k], np.sqrt(np.maximum(values[:k], 0) + 1e-6), float(values[:k].sum() / values.sum()))


def whiten(rows: DataFrame, w: Whitening, vector: str) -> DataFrame:
    """Adds ``whitened``."""
    names = [*rows.columns, "whitened"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", whitened array<double>"

    def run(batches):
        for b in batches:
            x = np.array(b.column(vector).to_pylist(), dtype=float).reshape(-1, len(w.mean))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list((x - w.mean) @ w.axes / w.scale), pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, schema)


def ridge(train: DataFrame, features: list[str], y: str, l2: float = 1.0) -> DataFrame:
    """Closed-form ridge whose intercept is penalised too, as ``(name, value)``."""
    names = ["intercept", *features]
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double"))
    _, _, g = gram(train.select(x.alias("v")), "v", len(names) + 1)
    w = np.linalg.solve(g[:-1, :-1] + l2 * np.eye(len(names)), g[:-1, -1])
    return train.sparkSession.createDataFrame(list(zip(names, w.tolist())), "name string, value double")


#: Of a forest, as Spark ML has them: bins of a feature, depth of a tree. Sums of cells by tree that a task may hold.
BINS, DEPTH, CELL_SUMS = 32, 5, 1 << 21


def forest(train: DataFrame, test: DataFrame, features: list[str], y: str, trees: int = 500, seed: int = 7, key: str | None = None) -> DataFrame:
    """``test`` with ``forest_pred``, the mean of ``trees`` regression trees on bootstrap samples, a third of the features at a node.

    Trees see features only as bins, so rows of equal bins, a cell, count by their weights' sums alone: where cells are few, tasks sum each
    tree's Poisson weights in one pass, and trees grow from cells. Else Spark ML's forest reads the rows for each level of the trees.
    A row's weights go by its ``key``, else by a hash of all its columns. Edges and cells are looked for first, so rows that are dear
    to make should be written.
    """
    edges = [_edges(train, f) for f in features]
    if not all(len(e) for e in edges):
        raise TooFewRowsError("no rows to grow trees from")
    shape = [len(e) - 1 for e in edges]
    if math.prod(shape) < 1 << 31:
        known, asked = (_cells(rows, features, edges) for rows in (train, test))
        most = CELL_SUMS // trees
        cells = [r["_c"] for r in known.select("_c").unionByName(asked.select("_c")).distinct().limit(most + 1).collect()]
        if len(cells) <= most:
            # runs of a cell are summed at once
            rows = known.select((F.col(key) if key else F.xxhash64(*train.columns)).alias("_k"), "_c", _known(y).alias("_y")).sortWithinPartitions("_c")
            sums = replicate_sums(rows, F.col("_k"), F.col("_c"), F.col("_y"), trees, seed)
            means = _grown(sums, np.array(sorted(cells)), shape, seed).groupBy("_c").agg(F.avg("p").alias("forest_pred"))
            return asked.join(F.broadcast(means), "_c", "left").select(*test.columns, "forest_pred")
    v = VectorAssembler(inputCols=features, outputCol="_x")
    model = RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, seed=seed, predictionCol="forest_pred").fit(v.transform(train))
    return model.transform(v.transform(test)).drop("_x")


def _known(name: str) -> Column:
    """A column as doubles; a missing value is an error."""
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"{name}: missing value"))).otherwise(x)


def _edges(train: DataFrame, feature: str) -> list[float]:
    """Edges of a feature's bins: all its values if these are no more than bins, else quantiles. A bin holds its upper end."""
    x = train.select(_known(feature).alias("x"))
    values: list[float] = []
    if x.agg(F.approx_count_distinct("x")).first()[0] <= 2 * BINS:
        values = sorted(r["x"] for r in x.distinct().limit(BINS + 1).collect())
        if not values:
            return []
    if not 0 < len(values) <= BINS:
        values = [*sorted(set(x.approxQuantile("x", [k / BINS for k in range(1, BINS)], 0.001))), math.inf]
    return [-math.inf, *np.nextafter(values[:-1], math.inf).tolist(), math.inf]


def _cells(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """``rows`` with ``_c``, the number of their bins, the last feature's running fastest."""
    names, c = [f"_b{i}" for i in range(len(features))], F.lit(0)
    given = rows.select("*", *[_known(f).alias(f"_v{i}") for i, f in enumerate(features)])
    for i, (n, e) in enumerate(zip(names, edges)):
        if len(e) > 2:
            given = Bucketizer(splits=e, inputCol=f"_v{i}", outputCol=n).transform(given)
            c = c * (len(e) - 1) + F.col(n).cast("int")
    return given.select(*rows.columns, c.alias("_c"))


def _grown(sums: DataFrame, cells: np.ndarray, shape: list[int], seed: int) -> DataFrame:
    """``(_c, p)``: what each tree predicts for each of ``cells``; a group is a tree, with a row for each cell that it may hold."""
    bins, take = np.stack(np.unravel_index(cells, shape), 1), math.ceil(len(shape) / 3)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        n, s, p = np.zeros((3, len(cells)))
        at = np.searchsorted(cells, part["c"].to_numpy())
        n[at], s[at] = part["n"].to_numpy(), part["s"].to_numpy()
        r = np.random.default_rng([seed, int(part["tree"].iloc[0])])
        nodes = [(np.arange(len(cells)), 0)] if n.sum() else []
        while nodes:
            node, level = nodes.pop()
            best, total, value = (0.0, None), n[node].sum(), s[node].sum()
            p[node] = value / total
            for f in r.choice(len(shape), take, replace=False) if level < DEPTH else ():
                a, b = (np.bincount(bins[node, f], x[node], shape[f]).cumsum()[:-1] for x in (n, s))
                ok = (a >= 1) & (total - a >= 1)
                gain = np.where(ok, b**2 / np.where(ok, a, 1) + (value - b) ** 2 / np.where(ok, total - a, 1) - value**2 / total, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), bins[node, f] <= gain.argmax())
            if best[1] is not None:
                nodes += [(node[best[1]], level + 1), (node[~best[1]], level + 1)]
        return pd.DataFrame({"_c": cells, "p": p} if n.sum() else {"_c": [], "p": []})

    trees = sums.select("c", F.posexplode(F.arrays_zip("n", "s")).alias("tree", "x")).select("tree", "c", "x.n", "x.s")
    return trees.groupBy("tree").applyInPandas(grow, "_c int, p double")


def logistic(features: list[str], y: str, l2: float) -> LogisticRegression:
    """Mean cross-entropy plus l2 times the squared norm, intercept free."""
    return LogisticRegression(featuresCol="_x", labelCol=y, regParam=2 * l2, elasticNetParam=0.0, standardization=False, tol=1e-9, maxIter=200)


def gate_scores(train: DataFrame, test: DataFrame, features: list[str], y: str, l2: float) -> DataFrame:
    """``test`` with ``score``, the probability of the gate that is fitted on ``train``."""
    v = VectorAssembler(inputCols=features, outputCol="_x")
    model = logistic(features, y, l2).fit(v.transform(train))
    scored = model.transform(v.transform(test)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*test.columns, "score")


def gate_crossfit(rows: DataFrame, features: list[str], y: str, group: str, grid: list[float], folds: int = 5, seed: int = 7) -> tuple[float, DataFrame]:
    """The l2 with the best out-of-fold AUROC (the first on ties), and the refitted coefficients.

    ``rows`` must hold no row of the calibration split; the caller filters.
    """
    v = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).persist()
    try:
        assigned = group_folds(rows, group, folds, seed).persist()

        def score(l2: float) -> float:
            def fit(train: DataFrame):
                model = logistic(features, y, l2).fit(train.drop("fold"))
                return lambda part: model.transform(part).select(y, vector_to_array("probability")[1].alias("_p"))

            return auroc(out_of_fold(v, assigned, group, folds, fit), "_p", y).first()["auroc"] or 0.0

        best = max(grid, key=score)
        model = logistic(features, y, best).fit(v)
    finally:
        v.unpersist()
    named = list(zip([*features, "intercept"], [*model.coefficients.tolist(), model.intercept]))
    return best, rows.sparkSession.createDataFrame(named, "name string, value double")


def ensemble(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Mean and population variance over models."""
    return scores.groupBy(key).agg(F.avg(score).alias("mean"), F.var_pop(score).alias("variance"))


def coefficient_report(coefficients: DataFrame, prior: DataFrame, refits: np.ndarray | None = None, names: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Coefficients ``(name, value)`` against the signs expected (``name, sign``); 0 is no flip, nor is what has no expected sign.

    With ``refits``, the coefficients of bootstrap replicates in the order of ``names``, also the percentile interval
    ``low, high`` of each; replicates that could not be fitted are left out."""
    j = coefficients.join(prior, "name", "left")
    j = j.withColumn("flipped", F.coalesce((F.col("value") != 0) & (F.signum("value") != F.signum("sign")), F.lit(False)))
    if refits is None:
        return j
    fitted = refits[np.isfinite(refits).all(axis=1)]
    ends = np.quantile(fitted, [(1 - level) / 2, (1 + level) / 2], axis=0) if len(fitted) else np.full((2, refits.shape[1]), np.nan)
    rows = [(n, float(a), float(b)) for n, a, b in zip(names, *ends)]
    return j.join(coefficients.sparkSession.createDataFrame(rows, "name string, low double, high double"), "name", "left")
