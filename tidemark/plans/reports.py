"""Reports and verdicts over the retrieval and prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import purge
from tidemark.operators import retrieve as R
from tidemark.operators import risk as K
from tidemark.operators import stats as B
from tidemark.operators import verdicts as V
from tidemark.plans import evaluation, retrieval


def d19(spark, sf):
    d = V.top1_distribution(retrieval.g6(spark, sf), low=0.5)
    return d.select("n", *[F.round(c, 4).alias(c) for c in ("median", "mean", "low_share", "p10", "p90")])


def d20(spark, sf):
    """The overlap is that of the queries' vectors with the other rows' (D18)."""
    key = F.md5(F.col("vector").cast("string"))
    q, p = (r.withColumn("key", key) for r in (retrieval.rows(spark, sf).where("id % 50 = 0"), retrieval.rows(spark, sf).where("id % 50 <> 0")))
    overlap = purge.key_overlap(q, p, "key").select("shared")
    return V.stage_gate(V.top1_distribution(retrieval.g6(spark, sf)).crossJoin(F.broadcast(overlap)), F.col("shared"), 0.4)  # one row each


def d22(spark, sf):
    return V.view_report(retrieval.g7(spark, sf)).withColumn("insufficient_views", F.array_join(F.array_sort(F.transform("insufficient_views", lambda v: v.cast("string"))), ","))


def g11(spark, sf):
    """Re-ranking a pool by another score, keeping both."""
    p = R.rank_scalars(retrieval.pool(spark, sf))
    score = F.round(0.7 * F.col("s_emb") + 0.3 * F.col("s_tan"), 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("rescore"), "memory_id")
    return p.withColumn("rescore", score).withColumn("rank", F.row_number().over(w)).where("rank <= 16").select("query_id", "memory_id", F.round("rescore", 6).alias("rescore"), "rank")


def k13(spark, sf):
    q = retrieval.rows(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.lit(4.5).alias("base"), "y")
    r = R.knn_residual(q.drop("y"), retrieval.neighbours(spark, sf)).join(q.select("query_id", "y"), "query_id").join(retrieval.g6(spark, sf), "query_id")
    r = r.withColumn("loss_base", F.pow(F.col("y") - F.col("base"), 2)).withColumn("loss_knn", F.pow(F.col("y") - F.col("base") - F.col("residual"), 2)).withColumn("entity_id", (F.col("y") % 2).cast("int"))
    return V.low_support_effect(r, 0.6, 3).select("entity_id", "n", F.round("effect", 4).alias("effect"))


def k19(spark, sf):
    p = evaluation.predictions(spark, sf)
    gates = K.gate_variants("gate", "loss_base", "loss_retr", "other")
    return V.method_table(p, gates, known=["mean"]).select("method", "n", *[F.round(c, 5).alias(c) for c in ("coverage", "harm_rate", "harm_rate_accepted", "loss")])


def l12(spark, sf):
    p = evaluation.predictions(spark, sf).where("split = 'test'")
    return V.entity_safe_coverage(p, "id", "entity_id", "gate", "loss_base", "loss_retr")


def k12(spark, sf):
    """H1 over the entities' mean changes of loss where support is low."""
    effects = evaluation.predictions(spark, sf).where("gate < 0.5").groupBy("entity_id").agg(F.avg(F.col("loss_base") - F.col("loss_retr")).alias("effect"))
    low = B.bootstrap_mean(effects.withColumn("k", F.crc32(F.col("entity_id").cast("binary"))), "k", "effect").first()["low"]
    return V.h1_verdict(effects, F.lit(low)).select("criterion", "passed")


def k15(spark, sf):
    p = evaluation.predictions(spark, sf)
    test = p.where("split = 'test'")
    safe = K.safe_coverage(K.coverage_curve(test, "id", "gate", "loss_base", "loss_retr", draws=10_000))
    return V.h3_verdict(safe, V.entity_safe_coverage(test, "id", "entity_id", "gate", "loss_base", "loss_retr"), K.validate(test, evaluation.certified(spark, sf))).select("criterion", F.round("value", 6).alias("value"), "passed")


def k20(spark, sf):
    """The measures of the method table for each ablation and each protocol."""
    p = evaluation.predictions(spark, sf)
    gates = {"whole": F.col("gate"), "without_support": F.col("gate") * 0.8, "without_conflict": F.least(F.col("gate") * 1.2, F.lit(1.0))}
    ablation = V.method_table(p, gates, required=()).select(F.lit("ablation").alias("kind"), F.col("method").alias("name"), "n", "coverage", "harm_rate", "loss")
    protocol = V.method_table(p, {"gate": F.col("gate")}, required=(), by="task").select(F.lit("protocol").alias("kind"), F.col("task").alias("name"), "n", "coverage", "harm_rate", "loss")
    return ablation.unionByName(protocol).select("kind", "name", "n", *[F.round(c, 5).alias(c) for c in ("coverage", "harm_rate", "loss")])


def l13(spark, sf):
    """The threshold at alpha, and at the fallback alpha."""
    c = evaluation.curve(spark, sf)
    out = [K.learn_then_test(K.with_pvalues(c, a), held_out=True).select(F.lit(a).alias("alpha"), "lam", "passed") for a in (0.05, 0.20)]
    return out[0].unionByName(out[1])


QUERIES = {"d19_top1_distribution": d19, "d20_stage_gate": d20, "d22_view_report": d22, "g11_rerank": g11, "k13_low_support_effect": k13, "k19_method_table": k19, "k12_h1_verdict": k12, "k15_h3_verdict": k15, "k20_ablations": k20, "l12_entity_safe_coverage": l12, "l13_fallback_certificate": l13}

_E, _P, _CURVE = retrieval._E, evaluation._P, evaluation._CURVE
_G6 = _E + ", t as (select query_id, round(tan, 6) as top1 from r where rt = 1), i as (select top1, row_number() over (order by top1) - 1 as i, count(*) over () as n from t)"


def _pvalues(alpha: float) -> str:
    return evaluation._PV.replace("0.1::double", f"{alpha}::double").replace("ln(0.9::double)", f"ln({1 - alpha}::double)")


def _certificate(alpha: float) -> str:
    return _P + _CURVE.format(by="", split="calib") + _pvalues(alpha) + f", k as (select *, n_accepted > 0 and least(p_hoeffding, p_bentkus) <= 0.05::double / 100 as ok from pv) select {alpha}::double as alpha, min(lam) filter (ok) as lam, count(*) filter (ok) as passed from k"


ORACLE = {
    "d19_top1_distribution": _G6
    + " select count(*) as n, round(median(top1), 4) as median, round(avg(top1), 4) as mean, round(avg((top1 < 0.5::double)::int), 4) as low_share, round(max(case when i = floor(0.1::double * (n - 1)) then top1 end), 4) as p10, round(max(case when i = floor(0.9::double * (n - 1)) then top1 end), 4) as p90 from i",
    "d20_stage_gate": _G6 + " select 'top1_too_high' as violation from (select median(top1) as m from t) where m > 0.4::double union all select 'key_overlap' from (select count(*) as n from (select distinct v from e where id % 50 = 0) q where v in (select v from e where id % 50 <> 0)) where n > 0",
    "d22_view_report": "with s as (select v as view, count(vec_id) as size from range(12) t(v) left join embeddings on label = v group by 1) select min(size) as smallest, max(size) as largest, count(*) filter (size < 50) as insufficient, count(*) as views, (list_sort(list(size)))[count(*) // 2 + 1] as median, array_to_string(list_sort(list(view::varchar) filter (size < 50)), ',') as insufficient_views from s",
    "g11_rerank": retrieval._POOL
    + """, x as (select *, round(0.7::double * b + 0.3::double * t, 9) as zz from k0), y as (select *, row_number() over (partition by query_id order by zz desc, memory_id) as rank from x) select query_id, memory_id, round(zz, 6) as rescore, rank from y where rank <= 16""",
    "k13_low_support_effect": _E
    + """, f as (select a.query_id, sum(alpha * a.y) as m from al a group by 1), u as (select f.query_id, f.m, e.y, round(r.tan, 6) as top1 from f join e on e.id = f.query_id join r on r.query_id = f.query_id and r.rt = 1)
      select y::int % 2 as entity_id, count(*) as n, round(avg(pow(y - 4.5::double, 2) - pow(y - m, 2)), 4) as effect from u where top1 < 0.6::double group by 1 having count(*) >= 3""",
    "k19_method_table": _P
    + """, v as (select loss_base, loss_retr, unnest([{'m': 'mean', 't': false}, {'m': 'gate', 't': gate >= 0.5::double}, {'m': 'naive', 't': true}, {'m': 'oracle', 't': loss_base - loss_retr > 0}, {'m': 'tanimoto', 't': other >= 0.5::double}]) as x from p), z as (select *, x.t as t, loss_retr > loss_base + 0.01::double as h from v)
      select x.m as method, count(*) as n, round(avg(t::int), 5) as coverage, round(avg((t and h)::int), 5) as harm_rate, round(avg(case when t then h::int end), 5) as harm_rate_accepted, round(avg(case when t then loss_retr else loss_base end), 5) as loss from z group by 1""",
    "k20_ablations": _P
    + """, v as (select 'ablation' as kind, unnest([{'m': 'whole', 'g': gate}, {'m': 'without_support', 'g': gate * 0.8::double}, {'m': 'without_conflict', 'g': least(gate * 1.2::double, 1)}]) as x, loss_base, loss_retr from p union all select 'protocol', {'m': task, 'g': gate}, loss_base, loss_retr from p),
      z as (select kind, x.m as name, x.g >= 0.5::double as t, loss_retr > loss_base + 0.01::double as h, loss_base, loss_retr from v) select kind, name, count(*) as n, round(avg(t::int), 5) as coverage, round(avg((t and h)::int), 5) as harm_rate, round(avg(case when t then loss_retr else loss_base end), 5) as loss from z group by 1, 2""",
    "l13_fallback_certificate": f"select * from ({_certificate(0.05)}) union all select * from ({_certificate(0.2)})",
}
