"""Reports and verdicts over tables that are already aggregated, shipped with the pass that feeds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import bootstrap as B
from tidemark.operators.ranking import global_rank, order_statistics
from tidemark.operators.stats import MissingBaselineError, cohens_d


def top1_distribution(top1: DataFrame, value: str = "top1", low: float = 0.35) -> DataFrame:
    """N, median, mean, lower-index deciles and the share below ``low`` of the best similarity of each query."""
    one = top1.select(F.lit(0).alias("_g"), value)
    picks = order_statistics(one, ["_g"], value, {"median": ("linear", 0.5), "p10": ("lower", 0.1), "p90": ("lower", 0.9)}).drop("_g", "n")
    stats = top1.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) < low).cast("double")).alias("low_share"))
    return stats.join(F.broadcast(picks), F.lit(True), "left")  # one row each


def stage_gate(summary: DataFrame, overlap: Column, most: float = 0.60) -> DataFrame:
    """Violations of a one-row summary: median above ``most`` or missing, or any overlap."""
    checks = F.array(F.when(F.col("median").isNull(), "top1_missing"), F.when(F.col("median") > most, "top1_too_high"), F.when(overlap > 0, "key_overlap"))
    return summary.select(F.explode(F.array_compact(checks)).alias("violation"))


def view_report(sizes: DataFrame) -> DataFrame:
    """Upper median, smallest, largest, number and list of insufficient views, of ``view, size, insufficient`` rows."""
    upper = order_statistics(sizes.select(F.lit(0).alias("_g"), "size"), ["_g"], "size", {"median": ("upper", 0.5)}).drop("_g", "n")
    return sizes.agg(F.min("size").alias("smallest"), F.max("size").alias("largest"), F.count_if("insufficient").alias("insufficient"), F.collect_list(F.when(F.col("insufficient"), F.col("view"))).alias("insufficient_views"), F.count("*").alias("views")).crossJoin(F.broadcast(upper))


def low_support_effect(rows: DataFrame, low: float = 0.35, least_rows: int = 5, entity: str = "entity_id") -> DataFrame:
    """Per entity with enough rows of low support, the mean change of loss (base less neighbours)."""
    d = rows.where(F.col("top1") < low).groupBy(entity).agg(F.count("*").alias("n"), F.avg(F.col("loss_base") - F.col("loss_knn")).alias("effect"))
    return d.where(F.col("n") >= least_rows)


def h1_verdict(effects: DataFrame, low: Column, share: float = 0.60, least_d: float = 0.2) -> DataFrame:
    """One row a criterion; a missing input leaves its verdict null."""
    one = effects.agg(low.alias("low"), F.avg((F.col("effect") > 0).cast("double")).alias("share"), cohens_d("effect").alias("d"))
    rows = F.array(
        F.struct(F.lit("ci_above_zero").alias("criterion"), F.col("low").alias("value"), (F.col("low") > 0).alias("passed")),
        F.struct(F.lit("entities_positive").alias("criterion"), F.col("share").alias("value"), (F.col("share") >= share).alias("passed")),
        F.struct(F.lit("effect_size").alias("criterion"), F.col("d").alias("value"), (F.col("d") >= least_d).alias("passed")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def criteria(one: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row ``(criterion, value, passed)`` for each check of a one-row table; a null value fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), v.cast("double").alias("value"), F.coalesce(p & v.isNotNull() & ~F.isnan(v.cast("double")), F.lit(False)).alias("passed")) for n, v, p in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def h2_verdict(difference: DataFrame, calib_auroc: Column | float, test_auroc: Column | float, cliff_auroc: Column | float, flips: Column | int, least_cliff: float = 0.65, most_gap: float = 0.10, most_flips: int = 2) -> DataFrame:
    """The gate ranks better than one feature (lower end of the AUROC difference above 0), also among
    activity cliffs, is as good on test rows as on calibration rows, and has few flipped coefficients."""
    c, t, f, n = (x if isinstance(x, Column) else F.lit(x) for x in (calib_auroc, test_auroc, cliff_auroc, flips))
    gap = F.abs(c.cast("double") - t.cast("double"))
    return criteria(difference, [("auroc_gain", F.col("low"), F.col("low") > 0), ("cliff_auroc", f, f >= least_cliff), ("auroc_gap", gap, gap <= most_gap), ("sign_flips", n, n <= most_flips)])


def h3_verdict(safe: DataFrame, entities: DataFrame, test: DataFrame, least: float = 0.30, share: float = 0.60, alpha: float = 0.10) -> DataFrame:
    """``safe`` has ``safe_coverage``, ``entities`` one row each with theirs, ``test`` the ``risk`` at the certified threshold."""
    one = safe.select(F.col("safe_coverage").alias("c")).crossJoin(F.broadcast(entities.agg(F.avg((F.col("safe_coverage") > 0).cast("double")).alias("s")))).crossJoin(F.broadcast(test.select(F.col("risk").alias("r"))))
    return criteria(one, [("safe_coverage", F.col("c"), F.col("c") >= least), ("entities_positive", F.col("s"), F.col("s") >= share), ("test_risk", F.col("r"), F.col("r") <= alpha)])


def select_backbones(table: DataFrame, mean: str = "mean", forest: str = "forest", slack: float = 0.05) -> DataFrame:
    """``(method, rmse, beats_mean, near_forest, role)``: among the macro rows of K11, the methods that beat the mean
    baseline and are at most ``slack`` worse than the forest; the best is ``A``, the next the ``runner_up``. Without any
    that is eligible one row says ``plan_c``."""
    macro = table.where("entity_id = '__macro__'").select("method", "rmse")
    at = macro.agg(F.max(F.when(F.col("method") == mean, F.col("rmse"))).alias("_m"), F.max(F.when(F.col("method") == forest, F.col("rmse"))).alias("_f"))
    own = macro.where(~F.col("method").isin(mean, forest)).crossJoin(F.broadcast(at))
    own = own.select("method", "rmse", (F.col("rmse") < F.col("_m")).alias("beats_mean"), F.coalesce(F.col("rmse") <= F.col("_f") * (1 + slack), F.lit(True)).alias("near_forest"))
    ok = F.col("beats_mean") & F.col("near_forest")
    place = F.row_number().over(Window.partitionBy("_ok").orderBy("rmse", "method"))  # a row for each method
    ranked = own.withColumn("_ok", ok).withColumn("_r", place)
    out = ranked.withColumn("role", F.when(F.col("_ok") & (F.col("_r") == 1), "A").when(F.col("_ok") & (F.col("_r") == 2), "runner_up").when(F.col("_ok"), "eligible").otherwise("rejected")).drop("_ok", "_r")
    none = out.agg(F.count_if(F.col("role") == "A").alias("n")).where("n = 0")
    return out.unionByName(none.select(F.lit("plan_c").alias("method"), F.lit(None).cast("double").alias("rmse"), F.lit(False).alias("beats_mean"), F.lit(False).alias("near_forest"), F.lit("plan_c").alias("role")))


def method_table(rows: DataFrame, gates: dict[str, Column], least: float | dict[str, float] = 0.5, eps: float = 0.01, required: tuple[str, ...] = ("mean",), known: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Each gate variant's coverage, harm and mean loss, over all rows and the accepted ones, in one pass.

    Values from ``least`` on accept; a gate may be given as ``(value, least)``."""
    if missing := set(required) - set(known if known is not None else gates):
        raise MissingBaselineError(str(sorted(missing)))
    pairs = {n: g if isinstance(g, tuple) else (g, F.lit(least)) for n, g in gates.items()}
    each = F.array(*[F.struct(F.lit(n).alias("method"), (g >= low).alias("taken")) for n, (g, low) in pairs.items()])
    keep = [by] if by else []
    long = rows.select(*keep, "loss_base", "loss_retr", F.explode(each).alias("_x")).select(*keep, "loss_base", "loss_retr", "_x.*")
    taken, harm = F.col("taken"), F.col("loss_retr") > F.col("loss_base") + eps
    return long.groupBy(*keep, "method").agg(
        F.count("*").alias("n"),
        F.avg(taken.cast("double")).alias("coverage"),
        F.avg((taken & harm).cast("double")).alias("harm_rate"),
        F.avg(F.when(taken, harm.cast("double"))).alias("harm_rate_accepted"),
        F.avg(F.when(taken, F.col("loss_retr")).otherwise(F.col("loss_base"))).alias("loss"),
    )


def entity_safe_coverage(rows: DataFrame, key: str, entity: str, gate: str, base: str, retrieved: str, draws: int = 2_000, steps: int = 100, seed: int = 7, level: float = 0.95, least: int = 20) -> DataFrame:
    """Each entity's largest coverage whose upper bound of the mean loss change is at most 0; 0 below ``least`` rows.

    One global rank by entity and gate gives every entity's own ranks, so no entity meets in one
    task; bootstrap sums by (entity, replicate, coverage) are combined before the shuffle.
    """
    r = rows.select(F.col(key).alias("k"), F.col(entity).alias("e"), F.col(gate).alias("g"), (F.col(retrieved) - F.col(base)).alias("d"))
    r = global_rank(r, [F.col("e").asc(), F.col("g").desc(), F.col("k").asc()])
    sizes = r.groupBy("e").agg(F.min("rank").alias("_first"), F.count("*").alias("n"))
    r = r.join(sizes, "e").withColumn("c", F.greatest(F.lit(1), F.ceil((F.col("rank") - F.col("_first") + 1) * steps / F.col("n") - 1e-9)).cast("int"))

    upper = B.nested_upper(B.replicate_sums(r, F.col("k"), F.col("c"), F.col("d"), draws, seed, F.col("e")), steps, level).withColumnRenamed("g", "e")
    ok = (F.col("upper") <= 0) & (F.col("c") * F.col("n") / steps >= least)
    found = upper.join(sizes.select("e", "n"), "e").groupBy("e").agg(F.max(F.when(ok, F.col("c") / steps)).alias("c"))
    return sizes.join(found, "e", "left").select(F.col("e").alias(entity), "n", F.coalesce("c", F.lit(0.0)).alias("safe_coverage"))
