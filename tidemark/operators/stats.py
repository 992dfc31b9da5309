"""Evaluation statistics as aggregates; ranks by value counts, bootstraps by Poisson weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import bootstrap as B
from tidemark.operators.ranking import cumulative, cumulative_by, join_groups, order_statistics
from tidemark.session import cut


class MissingBaselineError(ValueError):
    """A table of methods lacks one that must be there."""


def errors(y: str = "y", p: str = "pred") -> list[Column]:
    """K1, K2 as aggregates: ``rmse`` and ``r2``, null without rows or spread."""
    y_, d = F.col(y), F.col(y) - F.col(p)
    n, total = F.count("*"), F.sum(y_ * y_) - F.sum(y_) * F.sum(y_) / F.count("*")
    return [F.sqrt(F.avg(d * d)).alias("rmse"), F.when((n > 0) & (F.var_pop(y) > 0), 1 - F.sum(d * d) / total).alias("r2")]


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """K3: ``df`` with ties at their average rank; distinct values are ordered, rows are not."""
    n = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranked = cumulative(n, value, ["_n"]).select(F.col(value).alias("_v"), (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranked, df[value].eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """K4: correlation of average ranks, null for fewer than two rows or no spread."""
    r = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    return r.agg(F.count("*").alias("n"), F.when((F.count("*") > 1) & (F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rb") > 0), F.corr("_ra", "_rb")).alias("spearman"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """K5: by rank sum with ties averaged; null if only one label occurs."""
    n = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    c = cumulative(n, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return c.agg(pos.alias("pos"), neg.alias("neg"), F.when((pos > 0) & (neg > 0), wins / (pos * neg)).alias("auroc"))


def cohens_d(value: str, mu: float = 0.0) -> Column:
    """K6 as an aggregate; without spread 0, or infinity if the mean is off."""
    m, s = F.avg(value) - mu, F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return F.when(s > 0, m / s).when(m == 0, 0.0).otherwise(F.signum(m) * float("inf"))


def transfer_rates(base: str = "loss_base", retrieved: str = "loss_retr", gate: str = "gate", eps: float = 0.01, least: float = 0.5) -> list[Column]:
    """K9, with the rates among accepted rows."""
    worse, harmed, taken = F.col(retrieved) > F.col(base), F.col(retrieved) > F.col(base) + eps, F.col(gate) >= least
    rate = lambda c: F.avg(c.cast("double"))
    return [rate(worse).alias("negative_transfer"), rate(harmed).alias("harm_rate"), rate(taken).alias("coverage"), F.avg(F.when(taken, harmed.cast("double"))).alias("harm_rate_accepted")]


def bootstrap_mean(df: DataFrame, key: str, value: str, draws: int = 10_000, seed: int = 7, level: float = 0.95, by: str | None = None) -> DataFrame:
    """K7: mean and percentile interval of ``value``, for each ``by``."""
    g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    ci = B.interval(B.replicate_sums(df, F.col(key), F.lit(0), F.col(value), draws, seed, g), level)
    rows = df.where(F.col(value).isNotNull()).groupBy(g.alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.join(ci, "g").withColumnRenamed("g", by or "group")


def bootstrap_median(df: DataFrame, key: str, value: str, draws: int = 10_000, seed: int = 7, level: float = 0.95, by: str | None = None) -> DataFrame:
    """K7: median and percentile interval of ``value``, for each ``by``: weighted medians of all replicates, exact."""
    g = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    found = B.replicate_medians(df, key, value, draws, seed, F.col(by) if by else None)
    at = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    ci = found.select("g", F.explode("medians").alias("m")).groupBy("g").agg(at.alias("q")).select("g", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    rows = order_statistics(df.withColumn("g", g), ["g"], value, {"median": ("linear", 0.5)})
    return rows.join(ci, "g").withColumnRenamed("g", by or "group")


def bootstrap_auroc_difference(df: DataFrame, a: str, b: str, label: str, key: str, draws: int = 1_000, seed: int = 7) -> DataFrame:
    """K8: difference of two scores' AUROC over paired resamples; ``passed`` if the lower end is above 0.

    Each replicate's areas are exact, ties included, and both scores weigh a row alike in it.
    One-class replicates are left out.
    """
    blocks = [B.replicate_aurocs(df, key, c, label, draws, seed).toDF("block", c_) for c, c_ in ((a, "a"), (b, "b"))]
    pairs = blocks[0].join(blocks[1], "block").collect()  # two numbers a replicate
    d = np.array([x - y for r in pairs for x, y in zip(r["a"], r["b"]) if x is not None and y is not None])
    low, high = (float(x) for x in np.quantile(d, [0.025, 0.975])) if len(d) else (None, None)
    exact = [auroc(df, c, label).first()["auroc"] for c in (a, b)]
    point = None if None in exact else exact[0] - exact[1]
    return df.sparkSession.createDataFrame([(point, low, high, len(d), low is not None and low > 0)], "difference double, low double, high double, replicates long, passed boolean")


def spearman_by(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """K4 within groups: ``(by, spearman)``; average ranks from ordered value counts, so no group meets in one task. Both
    columns' values are ordered in one go."""
    rows = df.select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("_a").alias("v")), F.struct(F.lit(1).alias("w"), F.col("_b").alias("v")))).alias("_x")
    n = rows.select(*by, each).groupBy(*by, F.col("_x.w").alias("_w"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = cut(cumulative_by(n, [*by, "_w"], "_v", ["_n"]).select(*by, "_w", "_v", (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias("_r")))
    # pairs of values, counted, so that a common pair is one row of the joins
    out = rows.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_k"))
    for i, c in enumerate(("_a", "_b")):
        out = out.join(ranked.where(F.col("_w") == i).select(*by, F.col("_v").alias(c), F.col("_r").alias(f"_r{i}")), [*by, c])
    k, x, y = F.col("_k").cast("double"), F.col("_r0"), F.col("_r1")
    mean = lambda c: F.sum(k * c) / F.sum(k)
    sums = out.groupBy(*by).agg(mean(x).alias("mx"), mean(y).alias("my"))
    out = join_groups(out, sums, by)
    dx, dy = x - F.col("mx"), y - F.col("my")
    spread = F.nullif(F.sqrt(mean(dx * dx) * mean(dy * dy)), F.lit(0.0))  # null without spread
    return out.groupBy(*by).agg((mean(dx * dy) / spread).alias("spearman"))


def baseline_table(predictions: DataFrame, required: list[str] = ("mean",), ranks: bool = True) -> DataFrame:
    """Errors and (with ``ranks``) rank correlation by method and entity, and a ``__macro__`` row: rmse averaged over
    entities, r2 and spearman pooled."""
    keys = ["method", "entity_id"]
    rows = predictions.select(*keys, "y", "pred")
    if ranks:
        rows = cut(rows)  # else they are read once
    # every row also counts for all of its method
    both = rows.select("method", F.explode(F.array("entity_id", F.lit("__macro__"))).alias("entity_id"), "y", "pred")
    table = cut(both.groupBy(*keys).agg(F.count("*").alias("n"), *errors()))
    if missing := set(required) - {r[0] for r in table.select("method").distinct().collect()}:
        raise MissingBaselineError(str(sorted(missing)))
    if ranks:
        table = cut(table.join(spearman_by(both, keys, "y", "pred"), keys))
    macro = table.where("entity_id <> '__macro__'").groupBy("method").agg(F.avg("rmse").alias("_rmse"))
    table = table.join(macro, "method").withColumn("rmse", F.when(F.col("entity_id") == "__macro__", F.col("_rmse")).otherwise(F.col("rmse"))).drop("_rmse")
    mean = table.where("method = 'mean'").select("entity_id", F.col("rmse").alias("_m"))
    return table.join(mean, "entity_id").withColumn("delta_vs_mean", F.col("rmse") - F.col("_m")).drop("_m")


def lose_counts(table: DataFrame) -> DataFrame:
    """For each method, on how many entities it is worse than the mean baseline."""
    return table.where("entity_id <> '__macro__'").groupBy("method").agg(F.count_if(F.col("delta_vs_mean") > 0).alias("lost"), F.count("*").alias("entities"))


def risk_coverage_area(curve: DataFrame, x: str = "coverage", y: str = "risk") -> DataFrame:
    """The area under a risk-coverage curve by trapezoids; the curve has a row for each coverage (100 at most)."""
    w = Window.orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(step.alias("_a")).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def ks(df: DataFrame, side: str, value: str, by: str) -> DataFrame:
    """The largest distance of two samples' distribution functions, for each group.

    Right-continuous: rows of one value count together. Value counts are ordered over all groups
    at once, dealt by range, so no group meets in one task.
    """
    n = df.groupBy(by, value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) != 0).alias("b"))
    c = cumulative_by(n, [by], value, ["a", "b"])
    total = n.groupBy(by).agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    c = c.join(total, by)
    return c.groupBy(by).agg(F.max(F.abs(F.col("a_upto") / F.col("_na") - F.col("b_upto") / F.col("_nb"))).alias("ks"))


def shift_report(found: DataFrame, df: DataFrame, by: str, side: str, most: float = 0.15) -> DataFrame:
    """One row over the features' ``ks``: the largest finite one, how many exceed ``most``, whether any
    does, and the ratio of the two sides' rows."""
    one = found.agg(F.max(F.when(~F.isnan("ks"), F.col("ks"))).alias("max_ks"), F.count_if(F.col("ks") > most).alias("n_shifted"))
    rows = df.agg((F.count_if(F.col(side) != 0) / F.nullif(F.count_if(F.col(side) == 0), F.lit(0))).alias("size_ratio"))
    return one.crossJoin(F.broadcast(rows)).withColumn("shifted", F.coalesce(F.col("max_ks") > most, F.lit(False)))


def route_diagnostic(rows: DataFrame, task: str, gate: str) -> DataFrame:
    """Mean gate and rows by task, and whether the gate is lower where it should be closed."""
    t = rows.groupBy(F.col(task).alias("task")).agg(F.avg(gate).alias("mean_gate"), F.count("*").alias("n"))
    mean = lambda x: F.max(F.when(F.col("task") == x, F.col("mean_gate"))).over(Window.partitionBy())
    return t.withColumn("suppressed", mean("C") < mean("B"))
