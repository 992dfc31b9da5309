"""Distribution-free risk control: Learn-then-Test thresholds, risk-coverage curves, SafeCoverage."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import bootstrap as B
from tidemark.operators.ranking import global_rank

GRID = [round(i * 0.01, 2) for i in range(1, 101)]
ALPHA, DELTA, EPS = 0.10, 0.05, 0.01


class HoldOutError(ValueError):
    """A threshold was to be certified on data that is not held out."""


def risk_curve(rows: DataFrame, gate: str = "gate", base: str = "loss_base", retrieved: str = "loss_retr", eps: float = EPS, grid: list[float] = GRID, by: list[str] = ()) -> DataFrame:
    """L1: for each threshold: accepted rows, coverage, harmed rows and risk (0 if none is accepted).

    One pass counts rows by the number of thresholds they reach; at most ``len(grid) + 1`` rows a
    group are then summed from above.
    """
    by = list(by)
    reach = F.size(F.filter(F.array(*[F.lit(x) for x in grid]), lambda x: x <= F.col(gate)))
    harmed = F.col(retrieved) > F.col(base) + eps
    cells = rows.groupBy(*by, reach.alias("reach")).agg(F.count("*").alias("n"), F.count_if(harmed).alias("h"))
    lam = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(x).alias("lam")) for i, x in enumerate(grid, 1)])
    at = cells.withColumn("_l", F.explode(lam)).select(*by, "_l.*", "reach", "n", "h")
    ok = F.col("reach") >= F.col("place")
    out = at.groupBy(*by, "place", "lam").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_accepted"), F.sum(F.when(ok, F.col("h")).otherwise(0)).alias("n_harmed"), F.sum("n").alias("n"))
    return out.withColumn("coverage", F.col("n_accepted") / F.col("n")).withColumn("risk", F.when(F.col("n_accepted") > 0, F.col("n_harmed") / F.col("n_accepted")).otherwise(0.0))


def hoeffding(n: Column, risk: Column, alpha: float) -> Column:
    """L2"""
    return F.when((n <= 0) | (risk >= alpha), 1.0).otherwise(F.exp(-2.0 * n * (alpha - risk) * (alpha - risk)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed in the log domain."""
    if k >= n:
        return 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)])
    top = logs.max(initial=-np.inf)
    return min(1.0, float(np.exp(top) * np.exp(logs - top).sum()))


def with_pvalues(curve: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """L2 to L4: ``curve`` with Hoeffding, Bentkus and combined p-values. The curve is short; harmed rows
    are counted, not recovered from a rate."""
    names = curve.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curve.schema) + ", p_bentkus double"

    def run(batches):
        for b in batches:
            p = [1.0 if n <= 0 or h >= alpha * n else min(1.0, math.e * binomial_cdf(h, n, alpha)) for n, h in zip(b.column("n_accepted").to_pylist(), b.column("n_harmed").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*names, "p_bentkus"])

    out = curve.mapInArrow(run, schema).withColumn("p_hoeffding", hoeffding(F.col("n_accepted"), F.col("risk"), alpha))
    return out.withColumn("p", F.least("p_hoeffding", "p_bentkus"))


def learn_then_test(pvalues: DataFrame, held_out: bool, delta: float = DELTA, procedure: str = "bonferroni", order: str = "place", by: list[str] = ()) -> DataFrame:
    """The certified threshold ``lam``, null if none.

    ``bonferroni``: the smallest threshold whose p-value is at most delta over the grid's size.
    ``fixed_sequence``: in the given order up to the first failure; the last that passed.
    """
    if not held_out:
        raise HoldOutError("the calibration rows must be held out from fitting")
    by = list(by)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    some = F.col("n_accepted") > 0
    if procedure == "bonferroni":
        passed = pvalues.withColumn("_ok", some & (F.col("p") <= delta / F.count("*").over(group)))
        return passed.groupBy(*by).agg(F.min(F.when(F.col("_ok"), F.col("lam"))).alias("lam"), F.count_if("_ok").alias("passed"))
    failed = F.min(F.when(~(some & (F.col("p") <= delta)), F.col(order))).over(group)
    passed = pvalues.withColumn("_ok", F.coalesce(F.col(order) < failed, F.lit(True)))
    return passed.groupBy(*by).agg(F.max_by(F.when(F.col("_ok"), F.col("lam")), F.when(F.col("_ok"), F.col(order))).alias("lam"), F.count_if("_ok").alias("passed"))


def inner_order(inner: DataFrame) -> DataFrame:
    """``(lam, place)``: thresholds by the inner fold's p-value, then by size."""
    return inner.select("lam", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p", "lam")).alias("order"))


def least_n(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Accepted rows needed to certify at zero risk."""
    return math.ceil(math.log(1 / delta) / (2 * alpha * alpha))


def power(curve: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Whether each threshold could pass at zero risk, and whether the first one blocks the sequence."""
    best = F.least(F.exp(-2.0 * F.col("n_accepted") * alpha * alpha), F.exp(F.lit(1.0) + F.col("n_accepted") * math.log1p(-alpha)))
    out = curve.withColumn("reachable", (F.col("n_accepted") > 0) & (best <= delta)).withColumn("min_n", F.lit(least_n(alpha, delta)))
    return out.withColumn("blocked_at_first", F.min_by(~F.col("reachable"), "place").over(Window.partitionBy(F.lit(0))))


def validate(rows: DataFrame, lam: float | None, alpha: float = ALPHA, eps: float = EPS) -> DataFrame:
    """Risk and coverage at the certified threshold on test rows, against alpha."""
    if lam is None:
        return rows.sparkSession.createDataFrame([(None, None, None, False, "no_threshold")], "lam double, risk double, coverage double, passed boolean, reason string")
    c = risk_curve(rows, eps=eps, grid=[lam])
    return c.select("lam", "risk", "coverage", (F.col("risk") <= alpha).alias("passed"), F.when(F.col("risk") <= alpha, "").otherwise("risk").alias("reason"))


def coverage_curve(rows: DataFrame, key: str, gate: str, base: str, retrieved: str, eps: float = EPS, steps: int = 100, draws: int = 0, seed: int = 7, level: float = 0.95, least: int = 20) -> DataFrame:
    """For coverage 1/steps .. 1 of rows by gate, descending (ties by key): rows, threshold, mean loss
    change, share harmed, and with ``draws`` an upper bound of the mean (infinite for short prefixes).

    A row belongs to the first coverage that holds it; sums by that number, and by replicate of a
    Poisson bootstrap nested over them, are all that leaves the tasks.
    """
    n = rows.count()
    ends = [int(np.round(n * c / steps)) for c in range(1, steps + 1)]
    ranked = global_rank(rows.select(F.col(key).alias("k"), F.col(gate).alias("g"), (F.col(retrieved) - F.col(base)).alias("d")), [F.col("g").desc(), F.col("k").asc()])
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("rank"))) + 1
    ranked = ranked.withColumn("c", bucket)
    cells = ranked.groupBy("c").agg(F.count("*").alias("_n"), F.sum("d").alias("_s"), F.min("g").alias("_g"), F.count_if(F.col("d") > 0).alias("_h"), F.count_if(F.col("d") > eps).alias("_he"))
    grid = rows.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("c"))
    w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as steps
    upto = grid.join(cells, "c", "left").select("c", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(x) for x in ("_n", "_s", "_h", "_he")], F.min("_g").over(w).alias("threshold"))
    some = F.col("_n") > 0
    rate = lambda x: F.when(some, F.col(x) / F.col("_n"))
    out = upto.select((F.col("c") / steps).alias("coverage"), F.col("_n").alias("n"), "threshold", rate("_s").alias("mean_change"), rate("_h").alias("harm_rate"), rate("_he").alias("harm_rate_eps"))
    if not draws:
        return out

    sums = B.replicate_sums(ranked, F.col("k"), F.col("c"), F.col("d"), draws, seed)
    bound = B.nested_upper(sums, steps, level).select((F.col("c") / steps).alias("coverage"), F.col("upper").alias("_u"))
    out = out.join(bound, "coverage", "left")
    return out.withColumn("upper", F.when(F.col("n") >= least, F.col("_u")).otherwise(float("inf"))).drop("_u")


def safe_coverage(curve: DataFrame) -> DataFrame:
    """The largest coverage whose upper bound is at most 0, else 0."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("upper") <= 0, F.col("coverage"))), F.lit(0.0)).alias("safe_coverage"))


def gate_variants(gate: str, base: str, retrieved: str, top1: str) -> dict[str, tuple[Column, Column]]:
    """The values and thresholds of the gate variants: never (the mean baseline), the gate, always, the oracle
    (less the change of loss, accepted above 0), and the best similarity."""
    half, gain = F.lit(0.5), F.col(base) - F.col(retrieved)
    above = F.when(gain > 0, gain).otherwise(-1.0)
    return {"mean": (F.lit(0.0), half), "gate": (F.col(gate), half), "naive": (F.lit(1.0), half), "oracle": (above, F.lit(0.0)), "tanimoto": (F.col(top1), half)}
