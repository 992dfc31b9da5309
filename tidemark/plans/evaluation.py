"""Statistics, risk control and losses bound to ``orders`` (predictions) and ``documents`` with ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import learn as L
from tidemark.operators import bootstrap as B
from tidemark.operators import ranking
from tidemark.operators import risk as K
from tidemark.operators import stats as T
from tidemark.operators import verdicts as V
from tidemark.session import table, written


def predictions(spark, sf):
    """``orders`` as predictions: a gate, two losses, an outcome and two scores, all by hashes of the key."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    h = S.md5_number(k.cast("string"))
    gate = F.pmod(h, F.lit(1009)) / 1009.0
    base = F.col("o_totalprice") / 500000.0
    moved = F.when(gate > 0.6, F.when(h % 37 == 0, 0.2).otherwise(-0.05)).otherwise(F.when(h % 3 == 0, 0.05).otherwise(0.0))
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("entity_id"), F.element_at(F.array(*[F.lit(s) for s in ("train", "inner", "calib", "test")]), (k % 4 + 1).cast("int")).alias("split"),
        gate.alias("gate"), base.alias("loss_base"), (base + moved).alias("loss_retr"), (F.pmod(h, F.lit(1013)) / 1013.0).alias("other"), (F.pmod(h + (h % 7) * 100, F.lit(1009)) > 500).cast("int").alias("label"),
        (F.col("o_totalprice") / 1000.0).alias("y"), (F.lit(250.0) + F.pmod(h, F.lit(11)) - 5.0).alias("pred"), F.when(k % 3 == 0, "C").otherwise("B").alias("task"),
    )


def methods(spark, sf):
    p = predictions(spark, sf)
    own = p.select("entity_id", "y", F.lit("model").alias("method"), "pred")
    fitted = L.mean_predictor(p.where("split <> 'test'"), "entity_id", "y")
    return own.unionByName(L.apply_mean(p, fitted, "entity_id").select("entity_id", "y", F.lit("mean").alias("method"), F.col("mean_pred").alias("pred")))


def k1(spark, sf):
    return predictions(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"), *[F.round(c, 5).alias(n) for c, n in zip(T.errors(), ("rmse", "r2"))])


def k3(spark, sf):
    o = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    return T.average_ranks(o, "l_quantity", "rank").groupBy("l_quantity").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))


def k4(spark, sf):
    return T.spearman(predictions(spark, sf).withColumn("y", F.round("y", 0)), "y", "gate").withColumn("spearman", F.round("spearman", 6))


def k5(spark, sf):
    return T.auroc(predictions(spark, sf), "gate", "label").withColumn("auroc", F.round("auroc", 6))


def k6(spark, sf):
    p = predictions(spark, sf).withColumn("d", F.col("loss_retr") - F.col("loss_base"))
    return p.groupBy("entity_id").agg(F.round(T.cohens_d("d"), 5).alias("cohens_d"))


def k7(spark, sf):
    return T.bootstrap_mean(predictions(spark, sf).withColumn("d", F.col("loss_retr") - F.col("loss_base")), "id", "d", by="entity_id")


def k8(spark, sf):
    return T.bootstrap_auroc_difference(predictions(spark, sf), "gate", "other", "label", "id")


def k7_median(spark, sf):
    return T.bootstrap_median(predictions(spark, sf).withColumn("d", F.col("loss_retr") - F.col("loss_base")), "id", "d", draws=2_000, by="entity_id")


#: Signs that the gate's coefficients should have.
PRIOR = {"gate": 1, "loss_base": -1}


def report(spark, sf):
    """The gate's coefficients with intervals over 1,000 refits."""
    p = predictions(spark, sf).where("split in ('train', 'inner')").withColumn("u", S.utility_label(F.col("loss_base"), F.col("loss_retr")))
    names = list(PRIOR)
    best, coefficients = L.gate_crossfit(p, names, "u", "entity_id", [1e-4, 1e-3, 1e-2, 1e-1, 1.0])
    refits = B.logistic_refits(p, "id", names, "u", best, 1_000)
    prior = spark.createDataFrame(list(PRIOR.items()), "name string, sign int")
    return L.coefficient_report(coefficients, prior, refits, [*names, "intercept"])


def k9(spark, sf):
    return predictions(spark, sf).groupBy("split").agg(*[F.round(c, 6).alias(n) for c, n in zip(T.transfer_rates(), ("negative_transfer", "harm_rate", "coverage", "harm_rate_accepted"))])


def k11(spark, sf):
    return T.baseline_table(methods(spark, sf)).select("method", "entity_id", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("rmse", "r2", "spearman", "delta_vs_mean")])  # no negative zero


def k11_lost(spark, sf):
    return T.lose_counts(T.baseline_table(methods(spark, sf), ranks=False))


def k10(spark, sf):
    """Over the coverages that accept any row."""
    c = curve(spark, sf).where("n_accepted > 0")
    return T.risk_coverage_area(c).select(F.round("area", 6).alias("area"))


def k14(spark, sf):
    p = predictions(spark, sf)
    auc = lambda rows: T.auroc(rows, "gate", "label").first()["auroc"]
    cliffs = p.where("abs(y - pred) > 100")
    flips = report(spark, sf).where("flipped").count()
    return V.h2_verdict(T.bootstrap_auroc_difference(p, "gate", "other", "label", "id"), auc(p.where("split = 'calib'")), auc(p.where("split = 'test'")), auc(cliffs), flips).select("criterion", "passed")


def j11(spark, sf):
    """Baselines on test orders, fitted on all others; the split comes from a table of its own."""
    p = predictions(spark, sf)
    return L.mandatory_baselines(p, p.select("id", "split"), "id", "entity_id", "y", ["gate", "loss_base"])


def j10(spark, sf):
    p = predictions(spark, sf)
    own = p.where("split = 'test'").select("entity_id", "y", F.lit("model").alias("method"), (F.col("loss_base") * 500).alias("pred"))
    rival = p.where("split = 'test'").select("entity_id", "y", F.lit("rival").alias("method"), (F.col("y") + F.col("gate") * 10).alias("pred"))
    m = L.mean_predictor(p.where("split <> 'test'"), "entity_id", "y")
    mean = L.apply_mean(p.where("split = 'test'"), m, "entity_id").select("entity_id", "y", F.lit("mean").alias("method"), F.col("mean_pred").alias("pred"))
    worst = p.where("split = 'test'").select("entity_id", "y", F.lit("constant").alias("method"), "pred")
    table = T.baseline_table(own.unionByName(rival).unionByName(mean).unionByName(worst), ranks=False)
    return V.select_backbones(table).select("method", F.round("rmse", 4).alias("rmse"), "beats_mean", "near_forest", "role")


def j10_forest(spark, sf):
    """J10 with all that J11 fits, the forest among them, and a method that follows the outcome."""
    p = predictions(spark, sf)
    fitted = j11(spark, sf).select("entity_id", "y", "method", "pred")
    rival = p.where("split = 'test'").select("entity_id", "y", F.lit("rival").alias("method"), (F.col("y") + F.col("gate") * 10).alias("pred"))
    constant = p.where("split = 'test'").select("entity_id", "y", F.lit("constant").alias("method"), "pred")
    return V.select_backbones(T.baseline_table(fitted.unionByName(rival).unionByName(constant), ranks=False)).select("method", F.round("rmse", 4).alias("rmse"), "beats_mean", "near_forest", "role")


def k20_refits(spark, sf):
    """The gate fitted again without each of its features, on training rows, and measured on test rows."""
    p = predictions(spark, sf).withColumn("u", S.utility_label(F.col("loss_base"), F.col("loss_retr")))
    train, test, out = p.where("split in ('train', 'inner')"), p.where("split = 'test'"), None
    for left in (None, *PRIOR):
        names = [n for n in PRIOR if n != left]
        rows = V.method_table(L.gate_scores(train, test, names, "u", 1e-3), {f"without_{left}" if left else "whole": F.col("score")}, required=())
        out = rows if out is None else out.unionByName(rows)
    return out


def b14(spark, sf):
    p = losses(spark, sf).where("flag = 'none'")
    loss = S.tobit_loss(F.col("mu"), F.col("log_var"), F.col("y"), F.col("flag"))
    return p.groupBy("split").agg(*[F.round(S.reduced_loss(loss, F.col("gate"), r), 4).alias(r) for r in ("mean", "sum")])


def b23(spark, sf):
    p = losses(spark, sf)
    cal = S.calibration_loss(F.col("mu"), F.col("log_var"), F.col("y"))
    rank = F.when(F.col("id") % 3 == 0, F.abs(F.col("gate") - F.col("other")))
    terms = S.composed_loss(S.squared_loss(F.col("mu"), F.col("y"), F.lit("none")), rank, F.col("gate"), F.col("loss_base"), F.col("loss_retr"), cal)
    names = ["task", "rank", "utility", "harm", "calibration", "total", "utility_positive_rate", "marginal_mean"]
    return p.groupBy("split").agg(*terms).select("split", *[F.round(n, 5).alias(n) for n in names])


def k17(spark, sf):
    p = predictions(spark, sf)
    long = p.select(F.col("id") % 2, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.col(n), 3).alias("v")) for n in ("gate", "loss_base", "loss_retr")])).alias("x")).toDF("side", "x").select("side", "x.*")
    r = T.shift_report(T.ks(long, "side", "v", "feature"), p.select((F.col("id") % 2).alias("side")), "feature", "side")
    return r.select(F.round("max_ks", 6).alias("max_ks"), "n_shifted", F.round("size_ratio", 6).alias("size_ratio"), "shifted")


def j1_median(spark, sf):
    p = predictions(spark, sf)
    fitted = L.median_predictor(p.where("split <> 'test' and entity_id <> '5-LOW'"), "entity_id", "y")
    return L.apply_mean(p.where("split = 'test'"), fitted, "entity_id").groupBy("entity_id").agg(F.round(F.max("mean_pred"), 5).alias("median_pred"))


def k16(spark, sf):
    p = predictions(spark, sf)
    long = p.select(F.col("id") % 2, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.col(n), 3).alias("v")) for n in ("gate", "loss_base", "loss_retr")])).alias("x")).toDF("side", "x").select("side", "x.*")
    return T.ks(long, "side", "v", "feature").select("feature", F.round("ks", 6).alias("ks"), (F.col("ks") > 0.15).alias("shifted"))


def k18(spark, sf):
    return T.route_diagnostic(predictions(spark, sf), "task", "gate").withColumn("mean_gate", F.round("mean_gate", 6))


def curve(spark, sf, split="calib", by=()):
    return K.risk_curve(predictions(spark, sf).where(F.col("split") == split), by=by)


def l1(spark, sf):
    return curve(spark, sf, by=["entity_id"]).select("entity_id", "lam", "n_accepted", "n_harmed", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


def l4(spark, sf):
    return K.with_pvalues(curve(spark, sf)).select("lam", "n_accepted", F.round("p_hoeffding", 6).alias("p_hoeffding"), F.round("p_bentkus", 6).alias("p_bentkus"), F.round("p", 6).alias("p"))


def l5(spark, sf):
    return K.learn_then_test(K.with_pvalues(curve(spark, sf)), held_out=True)


def l5_fixed(spark, sf):
    order = K.inner_order(K.with_pvalues(curve(spark, sf, "inner")))
    return K.learn_then_test(K.with_pvalues(curve(spark, sf)).join(order, "lam"), held_out=True, procedure="fixed_sequence", order="order")


def certified(spark, sf):
    """The threshold that L5 certifies on the calibration rows; none if none passes."""
    return l5(spark, sf).first()["lam"]


def l7(spark, sf):
    return K.validate(predictions(spark, sf).where("split = 'test'"), certified(spark, sf)).select("lam", F.round("risk", 6).alias("risk"), F.round("coverage", 6).alias("coverage"), "passed", "reason")


def l8(spark, sf):
    return K.power(curve(spark, sf)).select("lam", "n_accepted", "reachable", "min_n", "blocked_at_first")


def l9(spark, sf):
    c = K.coverage_curve(predictions(spark, sf), "id", "gate", "loss_base", "loss_retr")
    return c.select("coverage", "n", F.round("threshold", 6).alias("threshold"), *[F.round(x, 5).alias(x) for x in ("mean_change", "harm_rate", "harm_rate_eps")])


def l10(spark, sf):
    return K.safe_coverage(K.coverage_curve(predictions(spark, sf), "id", "gate", "loss_base", "loss_retr", draws=10_000))


def rank(spark, sf):
    p = predictions(spark, sf).select("id", "gate")
    return ranking.global_rank(p, [F.col("gate").desc(), F.col("id").asc()]).select("id", "rank")


def b11(spark, sf):
    p = predictions(spark, sf)
    g = S.gate_score([F.col("gate"), F.col("loss_base")], [2.0, -1.0], 0.1, 0.6, apply=True)
    return p.select("id", F.round(g, 6).alias("g"))


def b12(spark, sf):
    p = predictions(spark, sf)
    std = L.standardizer(p, ["y", "pred"])
    return L.standardize(p, std).select("id", F.round("y", 4).alias("y"), F.round("pred", 4).alias("pred"))


def losses(spark, sf):
    """``predictions`` with a mean, a log variance and a censoring flag."""
    flag = F.element_at(F.array(F.lit("none"), F.lit("right"), F.lit("left")), (F.col("id") % 3 + 1).cast("int"))
    return predictions(spark, sf).withColumn("flag", flag).withColumn("mu", F.col("pred") / 100.0).withColumn("log_var", F.col("gate") * 4 - 2).withColumn("y", F.col("y") / 100.0)


def b13(spark, sf):
    p = losses(spark, sf)
    loss = S.tobit_loss(F.col("mu"), F.col("log_var"), F.col("y"), F.col("flag"))
    return p.groupBy("flag").agg(F.round(F.avg(loss), 5).alias("tobit"), F.round(F.avg(S.squared_loss(F.col("mu"), F.col("y"), F.col("flag"))), 5).alias("squared"), F.round(F.sum(loss * F.col("gate")) / F.count("*"), 5).alias("weighted"))


def b13_rows(spark, sf):
    p = losses(spark, sf).where("flag = 'none'")
    return p.select("id", F.round(S.tobit_loss(F.col("mu"), F.col("log_var"), F.col("y"), F.col("flag")), 5).alias("loss"))


def b17(spark, sf):
    p = predictions(spark, sf)
    u = S.utility_label(F.col("loss_base"), F.col("loss_retr"))
    d = F.col("loss_base") - F.col("loss_retr")
    return p.groupBy("split").agg(F.round(F.avg(u), 6).alias("utility_rate"), F.round(F.avg(S.gate_loss(F.col("gate"), u)), 5).alias("gate_loss"), F.round(F.avg(S.harm_loss(F.col("gate"), d)), 6).alias("harm_loss"))


def b20(spark, sf):
    p = losses(spark, sf)
    return p.groupBy("split").agg(F.round(S.calibration_loss(F.col("mu"), F.col("log_var"), F.col("y")), 5).alias("calibration"))


def b21(spark, sf):
    p = predictions(spark, sf)
    g = F.when(F.col("gate") > 0.5, F.col("gate")).otherwise(0.0)
    return p.select("id", F.round(S.routed(F.col("task"), F.col("y"), g, F.col("pred") - F.col("y")), 6).alias("prediction"))


def j1(spark, sf):
    p = predictions(spark, sf)
    return L.apply_mean(p.where("split = 'test'"), L.mean_predictor(p.where("split <> 'test' and entity_id <> '5-LOW'"), "entity_id", "y"), "entity_id").groupBy("entity_id").agg(F.round(F.max("mean_pred"), 5).alias("mean_pred"))


def j2(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    w = L.fit_whitening(e.where("vec_id % 5 <> 0"), "vector", 8)
    return L.whiten(e, w, "vector").select("vec_id", "whitened")


def j3(spark, sf):
    p = predictions(spark, sf)
    coefficients = L.ridge(p, ["gate", "loss_base"], "loss_retr")
    return coefficients.select("name", F.round("value", 6).alias("value"))


def j4(spark, sf):
    p = written(predictions(spark, sf).where("split in ('train', 'test')"))
    return L.forest(p.where("split = 'train'"), p.where("split = 'test'"), ["gate", "loss_base"], "loss_retr").select("id", "forest_pred")


def j5(spark, sf):
    p = predictions(spark, sf).where("split in ('train', 'inner')").withColumn("u", S.utility_label(F.col("loss_base"), F.col("loss_retr")))
    best, coefficients = L.gate_crossfit(p, ["gate", "loss_base"], "u", "entity_id", [1e-4, 1e-3, 1e-2, 1e-1, 1.0])
    return coefficients.withColumn("l2", F.lit(best))


def j7(spark, sf):
    p = predictions(spark, sf).select("id", F.explode(F.array(*[F.col(c).cast("double") for c in ("gate", "other", "loss_base")])).alias("s"))
    return L.ensemble(p, "id", "s").select("id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def j8(spark, sf):
    p = predictions(spark, sf).where("split = 'train'").withColumn("still", F.lit(1.0))
    return L.standardizer(p, ["y", "pred", "still"]).select("name", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "dead")


QUERIES = {
    "b11_gate_score": b11, "b12_clip_zscore": b12, "b13_tobit": b13, "b13_tobit_uncensored": b13_rows, "b17_utility_losses": b17, "b20_calibration_loss": b20, "b21_routed_prediction": b21,
    "j1_mean_predictor": j1, "j1_median_predictor": j1_median, "j10_select_backbones": j10, "j10_backbones_with_forest": j10_forest, "k20_refitted_ablations": k20_refits, "j11_mandatory_baselines": j11, "b14_reduced_loss": b14, "b23_composed_loss": b23, "j2_whitening": j2, "j3_ridge": j3, "j4_forest": j4, "j5_logistic_gate": j5, "j7_ensemble": j7, "j8_standardizer": j8,
    "k1_k2_errors": k1, "k3_average_rank": k3, "k4_spearman": k4, "k5_auroc": k5, "k6_cohens_d": k6, "k7_bootstrap_ci": k7, "k7_bootstrap_median": k7_median, "j9_coefficient_report": report, "k8_auroc_diff": k8, "k9_transfer_rates": k9, "k10_risk_coverage_area": k10, "k11_baseline_table": k11, "k11_lose_counts": k11_lost, "k14_h2_verdict": k14, "k17_shift_report": k17,
    "k16_ks": k16, "k18_route_diagnostic": k18, "l1_risk_curve": l1, "l4_pvalues": l4, "l5_learn_then_test": l5, "l5_fixed_sequence": l5_fixed, "l7_test_validation": l7, "l8_power": l8,
    "l9_risk_coverage": l9, "l10_safe_coverage": l10, "n3_global_rank": rank,
}

_P = """with o as (select *, ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint as h from orders),
  p0 as (select o_orderkey as id, o_orderpriority as entity_id, (['train', 'inner', 'calib', 'test'])[o_orderkey % 4 + 1] as split, (h % 1009) / 1009.0::double as gate, o_totalprice / 500000.0::double as loss_base, h,
    (h % 1013) / 1013.0::double as other, (((h + (h % 7) * 100) % 1009) > 500)::int as label, o_totalprice / 1000.0::double as y, 250.0::double + h % 11 - 5 as pred, case when o_orderkey % 3 = 0 then 'C' else 'B' end as task from o),
  p as (select *, loss_base + case when gate > 0.6::double then case when h % 37 = 0 then 0.2::double else -0.05::double end else case when h % 3 = 0 then 0.05::double else 0::double end end as loss_retr from p0),
  g as (select unnest(range(1, 101)) as i), lam as (select i as place, round(i * 0.01::double, 2) as lam from g)"""
_CURVE = ", c as (select {by} place, lam, count(*) filter (gate >= lam) as n_accepted, count(*) filter (gate >= lam and loss_retr > loss_base + 0.01::double) as n_harmed, count(*) as n from p, lam where split = '{split}' group by all), r as (select *, n_accepted / n::double as coverage, case when n_accepted > 0 then n_harmed / n_accepted::double else 0 end as risk from c)"
_PV = """, pv as (select r.*, case when n_accepted <= 0 or risk >= 0.1::double then 1 else exp(-2 * n_accepted * pow(0.1::double - risk, 2)) end as p_hoeffding,
    case when n_accepted <= 0 or n_harmed >= 0.1::double * n_accepted then 1 else least(1, exp(1::double) * list_sum(list_transform(range(n_harmed + 1), lambda k: exp(lgamma(n_accepted + 1.0::double) - lgamma(k + 1.0::double) - lgamma(n_accepted - k + 1.0::double) + k * ln(0.1::double) + (n_accepted - k) * ln(0.9::double))))) end as p_bentkus from r)"""

_K11 = """, f as (select entity_id, avg(y) as m from p where split <> 'test' group by 1), z as (select entity_id, y, 'model' as method, pred from p union all select entity_id, y, 'mean', m from p join f using (entity_id)),
  q as (select *, avg(y) over (partition by method, entity_id) as me, avg(y) over (partition by method) as ma, rank() over (partition by method, entity_id order by y) + (count(*) over (partition by method, entity_id, y) - 1) / 2::double as ry, rank() over (partition by method, entity_id order by pred) + (count(*) over (partition by method, entity_id, pred) - 1) / 2::double as rp,
    rank() over (partition by method order by y) + (count(*) over (partition by method, y) - 1) / 2::double as rya, rank() over (partition by method order by pred) + (count(*) over (partition by method, pred) - 1) / 2::double as rpa from z),
  e as (select method, entity_id, count(*) as n, sqrt(avg(pow(y - pred, 2))) as rmse, 1 - sum(pow(y - pred, 2)) / sum(pow(y - me, 2)) as r2, case when stddev_pop(rp) > 0 and stddev_pop(ry) > 0 then corr(ry, rp) end as spearman from q group by 1, 2),
  t as (select * from e union all select e.method, '__macro__', max(x.n), avg(rmse), max(x.r2), max(x.s) from e join (select method, count(*) as n, 1 - sum(pow(y - pred, 2)) / sum(pow(y - ma, 2)) as r2, case when stddev_pop(rpa) > 0 then corr(rya, rpa) end as s from q group by 1) x on x.method = e.method group by e.method),
  kt as (select t.*, t.rmse - b.rmse as delta from t join t b on b.entity_id = t.entity_id and b.method = 'mean')"""

ORACLE = {
    "b11_gate_score": _P + ", z as (select id, 1 / (1 + exp(-(0.1::double + 2 * gate - loss_base))) as g from p) select id, round(case when g >= 0.6::double then g else 0 end, 6) as g from z",
    "b12_clip_zscore": _P + ", m as (select avg(y) as ym, stddev_samp(y) as ys, avg(pred) as pm, stddev_samp(pred) as ps from p) select id, round(greatest(-5, least(5, (y - ym) / ys)), 4) as y, round(greatest(-5, least(5, (pred - pm) / ps)), 4) as pred from p, m",
    "b13_tobit_uncensored": _P + " select id, round(0.5::double * (pow(y / 100 - pred / 100, 2) / exp(gate * 4 - 2) + gate * 4 - 2), 5) as loss from p where id % 3 = 0",
    "b17_utility_losses": _P
    + """, u as (select *, (loss_retr < loss_base - 0.01::double)::int as u, greatest(1e-6::double, least(1 - 1e-6::double, gate)) as g from p)
      select split, round(avg(u), 6) as utility_rate, round(avg(-(u * ln(g) + (1 - u) * ln(1 - g))), 5) as gate_loss, round(avg(gate * greatest(0, loss_retr - loss_base)), 6) as harm_loss from u group by 1""",
    "b20_calibration_loss": _P
    + ", z as (select split, abs((y / 100 - pred / 100) / exp(0.5::double * (gate * 4 - 2))) as z from p) select split, round(("
    + " + ".join(f"abs(avg(1 / (1 + exp(-10 * ({q!r}::double - z)))) - {level!r}::double)" for level, q in S.levels())
    + ") / 10, 5) as calibration from z group by 1",
    "b21_routed_prediction": _P + " select id, round(case when task = 'B' and gate > 0.5::double then y + gate * (pred - y) else y end, 6) as prediction from p",
    "j1_mean_predictor": _P
    + """, t as (select * from p where split <> 'test' and entity_id <> '5-LOW'), m as (select entity_id, avg(y) as m from t group by 1) select entity_id, round(coalesce(max(m), (select avg(y) from t)), 5) as mean_pred from p left join m using (entity_id) where split = 'test' group by 1""",
    "j7_ensemble": _P + ", s as (select id, unnest([gate, other, loss_base]) as s from p) select id, round(avg(s), 6) as mean, round(var_pop(s), 6) as variance from s group by 1",
    "j8_standardizer": _P
    + """, t as (select unnest([{'name': 'y', 'v': y}, {'name': 'pred', 'v': pred}, {'name': 'still', 'v': 1::double}]) as x from p where split = 'train'), s as (select x.name as name, avg(x.v) as m, stddev_samp(x.v) as s from t group by 1)
      select name, round(m, 5) as mean, round(case when s <= 1e-6 then 1 else s end, 5) as std, s <= 1e-6 as dead from s""",
    "k1_k2_errors": _P + ", m as (select *, avg(y) over (partition by entity_id) as my from p) select entity_id, count(*) as n, round(sqrt(avg(pow(y - pred, 2))), 5) as rmse, round(1 - sum(pow(y - pred, 2)) / sum(pow(y - my, 2)), 5) as r2 from m group by 1",
    "k3_average_rank": "with r as (select l_quantity, rank() over (order by l_quantity) as r from lineitem) select l_quantity, count(*) as n, min(r) + (count(*) - 1) / 2::double as rank from r group by 1",
    "k4_spearman": _P + ", r as (select rank() over (order by round(y, 0)) + (count(*) over (partition by round(y, 0)) - 1) / 2::double as a, rank() over (order by gate) + (count(*) over (partition by gate) - 1) / 2::double as b from p) select count(*) as n, round(corr(a, b), 6) as spearman from r",
    "k5_auroc": _P + ", r as (select label, rank() over (order by gate) + (count(*) over (partition by gate) - 1) / 2::double as r from p) select sum(label)::bigint as pos, sum(1 - label)::bigint as neg, round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label))::double, 6) as auroc from r",
    "k6_cohens_d": _P + " select entity_id, round(avg(loss_retr - loss_base) / stddev_samp(loss_retr - loss_base), 5) as cohens_d from p group by 1",
    "k9_transfer_rates": _P
    + """ select split, round(avg((loss_retr > loss_base)::int), 6) as negative_transfer, round(avg((loss_retr > loss_base + 0.01::double)::int), 6) as harm_rate, round(avg((gate >= 0.5::double)::int), 6) as coverage,
      round(avg(case when gate >= 0.5::double then (loss_retr > loss_base + 0.01::double)::int end), 6) as harm_rate_accepted from p group by 1""",
    "k11_baseline_table": _P + _K11 + " select method, entity_id, n, round(rmse, 4) + 0 as rmse, round(r2, 4) + 0 as r2, round(spearman, 4) + 0 as spearman, round(delta, 4) + 0 as delta_vs_mean from kt",
    "k11_lose_counts": _P + _K11 + " select method, count(*) filter (delta > 0) as lost, count(*) as entities from kt where entity_id <> '__macro__' group by 1",
    "k10_risk_coverage_area": _P + _CURVE.format(by="", split="calib") + ", z as (select coverage as c, risk as r, lag(coverage) over w as pc, lag(risk) over w as pr from r where n_accepted > 0 window w as (order by coverage, place)) select round(coalesce(sum((c - pc) * (r + pr) / 2), 0), 6) as area from z",
    "j1_median_predictor": _P
    + """, t as (select * from p where split <> 'test' and entity_id <> '5-LOW'), m as (select entity_id, median(y) as m from t group by 1) select entity_id, round(coalesce(max(m), (select median(y) from t)), 5) as median_pred from p left join m using (entity_id) where split = 'test' group by 1""",
    "j10_select_backbones": _P
    + """, tm as (select entity_id, avg(y) as m from p where split <> 'test' group by 1), te as (select * from p where split = 'test'), z as (select entity_id, y, 'model' as method, loss_base * 500 as pred from te union all select entity_id, y, 'rival', y + gate * 10 from te union all select entity_id, y, 'mean', m from te join tm using (entity_id) union all select entity_id, y, 'constant', pred from te),
      e as (select method, entity_id, sqrt(avg(pow(y - pred, 2))) as rmse from z group by 1, 2), a as (select method, avg(rmse) as rmse from e group by 1), oo as (select method, rmse, rmse < (select rmse from a where method = 'mean') as b from a where method <> 'mean'),
      r as (select *, row_number() over (partition by b order by rmse, method) as i from oo) select method, round(rmse, 4) as rmse, b as beats_mean, true as near_forest, case when b and i = 1 then 'A' when b and i = 2 then 'runner_up' when b then 'eligible' else 'rejected' end as role from r
      union all select 'plan_c', null, false, false, 'plan_c' where not exists (select 1 from r where b)""",
    "b14_reduced_loss": _P + ", l as (select split, gate * 0.5::double * (pow(y / 100 - pred / 100, 2) / exp(gate * 4 - 2) + gate * 4 - 2) as l from p where id % 3 = 0) select split, round(sum(l) / count(*), 4) as mean, round(sum(l), 4) as sum from l group by 1",
    "b23_composed_loss": _P
    + """, u as (select *, (loss_retr < loss_base - 0.01::double)::int as u, greatest(1e-6::double, least(1 - 1e-6::double, gate)) as g, abs((y / 100 - pred / 100) / exp(0.5::double * (gate * 4 - 2))) as z from p),
      t as (select split, avg(pow(pred / 100 - y / 100, 2)) as task, avg(case when id % 3 = 0 then abs(gate - other) end) as rank, avg(-(u * ln(g) + (1 - u) * ln(1 - g))) as utility, avg(gate * greatest(0, loss_retr - loss_base)) as harm, ("""
    + " + ".join(f"abs(avg(1 / (1 + exp(-10 * ({q!r}::double - z)))) - {level!r}::double)" for level, q in S.levels())
    + """) / 10 as calibration, avg(u) as up, avg(loss_base - loss_retr) as mm from u group by 1)
      select split, round(task, 5) as task, round(rank, 5) as rank, round(utility, 5) as utility, round(harm, 5) as harm, round(calibration, 5) as calibration, round(task + 0.1::double * rank + 0.1::double * (utility + 0.5::double * harm) + 0.1::double * calibration, 5) as total, round(up, 5) as utility_positive_rate, round(mm, 5) as marginal_mean from t""",
    "k17_shift_report": _P
    + """, l as (select id % 2 as side, unnest([{'f': 'gate', 'v': round(gate, 3)}, {'f': 'loss_base', 'v': round(loss_base, 3)}, {'f': 'loss_retr', 'v': round(loss_retr, 3)}]) as x from p), n as (select x.f as f, x.v as v, count(*) filter (side = 0) as a, count(*) filter (side <> 0) as b from l group by all),
      c as (select f, abs(sum(a) over w / sum(a) over (partition by f)::double - sum(b) over w / sum(b) over (partition by f)::double) as d from n window w as (partition by f order by v)), k as (select f, max(d) as ks from c group by 1)
      select round(max(ks), 6) as max_ks, count(*) filter (ks > 0.15::double) as n_shifted, round((select count(*) filter (id % 2 <> 0) / count(*) filter (id % 2 = 0)::double from p), 6) as size_ratio, max(ks) > 0.15::double as shifted from k""",
    "k16_ks": _P
    + """, l as (select id % 2 as side, unnest([{'f': 'gate', 'v': round(gate, 3)}, {'f': 'loss_base', 'v': round(loss_base, 3)}, {'f': 'loss_retr', 'v': round(loss_retr, 3)}]) as x from p), n as (select x.f as f, x.v as v, count(*) filter (side = 0) as a, count(*) filter (side <> 0) as b from l group by all),
      c as (select f, abs(sum(a) over w / sum(a) over (partition by f)::double - sum(b) over w / sum(b) over (partition by f)::double) as d from n window w as (partition by f order by v)) select f as feature, round(max(d), 6) as ks, max(d) > 0.15::double as shifted from c group by 1""",
    "k18_route_diagnostic": _P + ", t as (select task, avg(gate) as m, count(*) as n from p group by 1) select task, round(m, 6) as mean_gate, n, (select m from t where task = 'C') < (select m from t where task = 'B') as suppressed from t",
    "l1_risk_curve": _P + _CURVE.format(by="entity_id,", split="calib") + " select entity_id, lam, n_accepted, n_harmed, round(coverage, 6) as coverage, round(risk, 6) as risk from r",
    "l4_pvalues": _P + _CURVE.format(by="", split="calib") + _PV + " select lam, n_accepted, round(p_hoeffding, 6) as p_hoeffding, round(p_bentkus, 6) as p_bentkus, round(least(p_hoeffding, p_bentkus), 6) as p from pv",
    "l5_learn_then_test": _P + _CURVE.format(by="", split="calib") + _PV + ", k as (select *, n_accepted > 0 and least(p_hoeffding, p_bentkus) <= 0.05::double / 100 as ok from pv) select min(lam) filter (ok) as lam, count(*) filter (ok) as passed from k",
    "l7_test_validation": _P
    + _CURVE.format(by="", split="calib")
    + _PV
    + """, k as (select *, n_accepted > 0 and least(p_hoeffding, p_bentkus) <= 0.05::double / 100 as ok from pv), ct as (select min(lam) filter (ok) as lam from k),
      a as (select lam, count(*) filter (gate >= lam) as n, count(*) filter (gate >= lam and loss_retr > loss_base + 0.01::double) as h, count(*) as t from p, ct where split = 'test' group by lam), z as (select *, case when n > 0 then h / n::double else 0 end as risk from a)
      select lam, case when lam is not null then round(risk, 6) end as risk, case when lam is not null then round(n / t::double, 6) end as coverage, lam is not null and risk <= 0.1::double as passed, case when lam is null then 'no_threshold' when risk <= 0.1::double then '' else 'risk' end as reason from z""",
    "l8_power": _P
    + _CURVE.format(by="", split="calib")
    + """, w as (select *, n_accepted > 0 and least(exp(-2 * n_accepted * 0.01::double), exp(1 + n_accepted * ln(0.9::double))) <= 0.05::double as reachable from r) select lam, n_accepted, reachable, 150 as min_n, (select not reachable from w where place = 1) as blocked_at_first from w""",
    "l9_risk_coverage": _P
    + """, s as (select gate, loss_retr - loss_base as d, row_number() over (order by gate desc, id) as k from p), e as (select i, round_even(i * (select count(*) from p) / 100::double, 0) as n from g)
      select i / 100::double as coverage, count(*) as n, round(min(gate), 6) as threshold, round(avg(d), 5) as mean_change, round(avg((d > 0)::int), 5) as harm_rate, round(avg((d > 0.01::double)::int), 5) as harm_rate_eps from e join s on s.k <= e.n group by i""",
    "n3_global_rank": _P + " select id, row_number() over (order by gate desc, id) as rank from p",
}
