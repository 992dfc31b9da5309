"""Retrieval and support features bound to ``embeddings``: queries are ids divisible by 50, against all other rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import jaccard, rank_target
from tidemark.operators import annotate, cells
from tidemark.operators import retrieve as R
from tidemark.session import cut, table


def rows(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    bits = F.transform("embedding", lambda x: (x > 0).cast("double"))
    items = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return e.select(F.col("vec_id").alias("id"), F.lit(0).alias("view"), v.alias("vector"), bits.alias("bits"), items.alias("items"), F.col("label").cast("double").alias("y"))


def sides(spark, sf, vector="vector"):
    r = rows(spark, sf)
    q = r.where("id % 50 = 0").select(F.col("id").alias("query_id"), "view", F.col(vector).alias("vector"))
    return q, r.select(F.col("id").alias("memory_id"), "view", F.col(vector).alias("vector"))


#: Candidates of each source, of the pool, and of its top.
SOURCE, POOL, TOP = 512, R.POOL, R.TOP


def tanimoto(spark, sf, k=SOURCE):
    return R.topk(*sides(spark, sf, "bits"), "view", k, "jaccard")


def cosine(spark, sf, k=SOURCE):
    return R.topk(*sides(spark, sf), "view", k)


def g2(spark, sf):
    return tanimoto(spark, sf).select("query_id", "memory_id", F.round("sim", 6).alias("sim"), "rank")


def g4(spark, sf):
    return cosine(spark, sf).select("query_id", "memory_id", F.round("sim", 6).alias("sim"), "rank")


def g3(spark, sf):
    return R.lsh_topk(*sides(spark, sf, "bits"), "view", TOP).select("query_id", "memory_id", F.round("sim", 6).alias("sim"), "rank")


def g3_cells(spark, sf):
    q, p = sides(spark, sf, "bits")
    return cells.cell_topk(q, cells.build_index(p, "view", TOP, "jaccard"), TOP).select("query_id", "memory_id", F.round("sim", 6).alias("sim"), "rank")


def pool(spark, sf):
    """The union of both sources, all similarities recomputed, fused."""
    a, b = tanimoto(spark, sf).select("query_id", "memory_id"), cosine(spark, sf).select("query_id", "memory_id")
    both = a.withColumn("hit_tan", F.lit(True)).withColumn("hit_emb", F.lit(False)).unionByName(b.withColumn("hit_tan", F.lit(False)).withColumn("hit_emb", F.lit(True)))
    met = both.groupBy("query_id", "memory_id").agg(F.max("hit_tan").alias("hit_tan"), F.max("hit_emb").alias("hit_emb"))
    r = rows(spark, sf)
    q = r.select(F.col("id").alias("query_id"), F.col("vector").alias("qv"), F.col("items").alias("qi"), F.col("y").alias("yq"))
    m = r.select(F.col("id").alias("memory_id"), F.col("vector").alias("mv"), "items", "y")
    c = met.join(q, "query_id").join(m, "memory_id")
    c = c.withColumn("s_tan", F.round(jaccard(F.col("qi"), F.col("items")), 9)).withColumn("s_emb", F.round(annotate.cosine(F.col("qv"), F.col("mv")), 9)).withColumn("s_aux", F.lit(None).cast("double"))
    return cut(R.fuse(c.drop("qv", "mv", "qi"), POOL))


def g5(spark, sf):
    return pool(spark, sf).select("query_id", "memory_id", "hit_tan", "hit_emb", F.round("stage1", 6).alias("stage1"), "pool_rank")


def g6(spark, sf):
    return tanimoto(spark, sf, 1).select("query_id", F.round("sim", 6).alias("top1"))


def views(spark, sf):
    """Labels as views, two of them without rows."""
    p = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("view"), "vec_id")
    return p, R.sufficiency(p, spark.range(12).select(F.col("id").alias("view")), "view", 50)


def g7(spark, sf):
    return views(spark, sf)[1]


def g7_pool(spark, sf):
    p, sizes = views(spark, sf)
    return R.usable_pool(p, sizes, "view").groupBy("view").agg(F.count("*").alias("n"))


def neighbours(spark, sf):
    r = rows(spark, sf)
    n = cosine(spark, sf, TOP).withColumn("sim", F.round("sim", 6))
    n = n.join(r.select(F.col("id").alias("memory_id"), "y"), "memory_id").join(r.select(F.col("id").alias("query_id"), F.col("y").alias("yq")), "query_id")
    return n.withColumn("rho", rank_target(F.col("y"), F.col("yq")))


def g10(spark, sf):
    return R.rank_scalars(neighbours(spark, sf), "sim", "rank").select("query_id", "memory_id", F.round("rank_norm", 6).alias("rank_norm"), F.round("score_z", 3).alias("score_z"))


def g10_meta(spark, sf):
    r = rows(spark, sf).select(F.col("id").alias("memory_id"), F.when(F.col("id") % 7 != 0, F.col("y")).alias("y"), F.when(F.col("y") % 3 == 0, "right").otherwise("none").alias("flag"), (F.col("id") % 5).alias("n_records"))
    m = R.candidate_meta(r, r.where("memory_id % 50 <> 0"))
    return m.select("memory_id", "is_censored", F.round("log_records", 6).alias("log_records"), F.round("y_std", 5).alias("y_std"), "has_label")


def g12(spark, sf):
    a = R.attention(neighbours(spark, sf), "sim", 0.1)
    return a.groupBy("query_id").agg(F.round(F.sum(F.col("alpha") * F.col("y")), 5).alias("pooled"), F.round(F.max("alpha"), 5).alias("top"))


def g13(spark, sf):
    q = rows(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), (F.lit(4.5)).alias("base"))
    return R.knn_residual(q, neighbours(spark, sf)).select("query_id", F.round("residual", 5).alias("residual"))


def g14(spark, sf):
    return R.listwise_loss(neighbours(spark, sf), "sim", "rho").withColumn("loss", F.round("loss", 5))


def g15(spark, sf):
    return R.pairwise_loss(neighbours(spark, sf), "sim", "rho", 0.1).withColumn("loss", F.round("loss", 5))


def h1(spark, sf):
    p = pool(spark, sf).withColumnRenamed("stage1", "score").withColumn("is_topk", F.col("pool_rank") <= TOP)
    p = p.withColumn("match_conf", F.pmod(F.col("memory_id"), F.lit(97)) / 97.0).withColumn("family_id", (F.col("memory_id") % 7).cast("string")).withColumn("assay_compatible", (F.col("memory_id") % 3 != 0).cast("int"))
    alpha = R.attention(p.where("is_topk"), "score", 0.5).select("query_id", "memory_id", "alpha")
    p = p.join(alpha, ["query_id", "memory_id"], "left")
    base = p.select("query_id").distinct().select("query_id", (F.col("query_id") % 10 / 10.0).alias("base_ensemble_variance"), F.lit(0.5).alias("base_aleatoric_sigma"))
    f = R.support_features(p, base)
    return f.select("query_id", *[(F.round(c, 5) + 0.0).alias(c) for c in R.FEATURES])


QUERIES = {
    "g2_tanimoto_topk": g2, "g3_lsh_recall": g3, "g3_cell_index": g3_cells, "g4_cosine_topk": g4, "g5_fused_pool": g5, "g6_top1": g6, "g7_view_sufficiency": g7, "g7_usable_pool": g7_pool, "g10_rank_scalars": g10, "g10_candidate_meta": g10_meta,
    "g12_attention_pool": g12, "g13_knn_residual": g13, "g14_listwise_loss": g14, "g15_pairwise_loss": g15, "h1_support_features": h1,
}

_E = """with e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) as items, label::double as y from embeddings),
  p as (select q.id as query_id, m.id as memory_id, q.y as yq, m.y as y, m.items, round(list_cosine_similarity(q.v, m.v), 12) as emb, len(list_intersect(q.items, m.items)) / len(list_distinct(list_concat(q.items, m.items)))::double as tan0
    from e q join e m on q.id % 50 = 0 and m.id <> q.id),
  pt as (select *, round(tan0, 12) as tan from p),
  r as (select *, row_number() over (partition by query_id order by emb desc, memory_id) as re, row_number() over (partition by query_id order by tan desc, memory_id) as rt from pt),
  n as (select query_id, memory_id, round(emb, 6) as sim, re as rank, y, -abs(y - yq) as rho from r where re <= 16),
  a as (select *, exp((sim - max(sim) over w) / 0.1::double) as ex from n window w as (partition by query_id)), al as (select *, ex / sum(ex) over (partition by query_id) as alpha from a)"""
_POOL = _E + """, c as (select query_id, memory_id, y, items, round(tan, 9) as t, round(emb, 9) as b, rt <= 512 as hit_tan, re <= 512 as hit_emb, round(0.5::double * round(tan, 9) + 0.35::double * round(emb, 9), 12) as s from r where rt <= 512 or re <= 512),
  z as (select *, row_number() over (partition by query_id order by s desc, memory_id) as pool_rank from c), k0 as (select * from z where pool_rank <= 256)"""
_H1 = _POOL + """, k as (select *, memory_id % 97 / 97.0::double as mc, memory_id % 7 as fam, (memory_id % 3 <> 0)::int as assay, exp((s - max(s) over w) / 0.5::double) as ex from k0 where pool_rank <= 16 window w as (partition by query_id)),
  ka as (select *, ex / sum(ex) over (partition by query_id) as al, row_number() over (partition by query_id order by t desc, memory_id) as tr from k),
  f1 as (select query_id, -sum(al * ln(al + 1e-12::double)) as alpha_entropy, 1 / sum(al * al) as alpha_ess, (max(s) - max(case when pool_rank = 2 then s end)) / (max(s) - min(s) + 1e-6::double) as score_margin_norm, max(t) as tanimoto_max, avg(t) as tanimoto_mean, stddev_pop(t) as tanimoto_std,
    max(t) - max(case when tr = 2 then t end) as tanimoto_top1_top2_gap, max(b) as emb_sim_max, avg(b) as emb_sim_mean, stddev_pop(b) as emb_sim_std, max(mc) as match_conf_max, avg(mc) as match_conf_mean, stddev_pop(mc) as match_conf_std, count(distinct fam) / count(*)::double as unique_scaffold_ratio,
    avg(assay) as assay_compatible_ratio, var_pop(y) as vk, count(*) filter (t >= 0.7::double) as hk from ka group by 1),
  md as (select *, median(y) over (partition by query_id) as med from k0),
  f0 as (select query_id, (quantile_cont(s, 0.5::double) - avg(s)) / greatest(stddev_pop(s), 1e-9::double) as rank_zscore_q50, (quantile_cont(s, 0.75::double) - avg(s)) / greatest(stddev_pop(s), 1e-9::double) as rank_zscore_q75, (quantile_cont(s, 0.9::double) - avg(s)) / greatest(stddev_pop(s), 1e-9::double) as rank_zscore_q90,
    var_pop(y) as neighbor_label_variance, median(abs(y - med)) as neighbor_label_mad, max(y) - min(y) as neighbor_label_range, count(*) filter (t >= 0.7::double) as h0 from md group by 1),
  pr as (select a.query_id, a.pool_rank <= 16 and b.pool_rank <= 16 as top, abs(a.y - b.y) as g, len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::double as j from k0 a join k0 b on a.query_id = b.query_id and a.memory_id < b.memory_id),
  f2 as (select query_id, avg(j) filter (top) as pairwise_tanimoto_mean, stddev_pop(j) filter (top) as pairwise_tanimoto_std, avg((j >= 0.6::double and g >= 1)::int) * coalesce(avg(g) filter (j >= 0.6::double and g >= 1), 0) as activity_cliff_score from pr group by 1),
  f as (select *, case when neighbor_label_variance > 1e-12::double then vk / neighbor_label_variance else 0 end as var_ratio_k_over_k0, greatest(h0 - hk, 0)::double as dropped_high_tanimoto_cnt, query_id % 10 / 10.0::double as base_ensemble_variance, 0.5::double as base_aleatoric_sigma from f1 join f0 using (query_id) join f2 using (query_id))"""

ORACLE = {
    "g2_tanimoto_topk": _E + " select query_id, memory_id, round(tan, 6) as sim, rt as rank from r where rt <= 512",
    "g4_cosine_topk": _E + " select query_id, memory_id, round(emb, 6) as sim, re as rank from r where re <= 512",
    "g5_fused_pool": _POOL + " select query_id, memory_id, hit_tan, hit_emb, round(s, 6) as stage1, pool_rank from k0",
    "g6_top1": _E + " select query_id, round(tan, 6) as top1 from r where rt = 1",
    "g7_view_sufficiency": "select v as view, count(vec_id) as size, count(vec_id) < 50 as insufficient from range(12) t(v) left join embeddings on label = v group by 1",
    "g7_usable_pool": "select label::bigint as view, count(*) as n from embeddings group by 1 having count(*) >= 50",
    "g10_rank_scalars": _E + " select query_id, memory_id, round((rank - 1) / 15::double, 6) as rank_norm, round((sim - avg(sim) over w) / greatest(stddev_samp(sim) over w, 1e-6), 3) as score_z from n window w as (partition by query_id)",
    "g10_candidate_meta": "with r as (select vec_id as memory_id, case when vec_id % 7 <> 0 then label::double end as y, label % 3 = 0 as c, vec_id % 5 as n from embeddings), t as (select avg(y) as mu, greatest(stddev_samp(y), 1e-6::double) as sd from r where memory_id % 50 <> 0) select memory_id, c::int as is_censored, round(ln(1 + n::double), 6) as log_records, round(coalesce((y - mu) / sd, 0), 5) as y_std, (y is not null)::int as has_label from r, t",
    "g12_attention_pool": _E + " select query_id, round(sum(alpha * y), 5) as pooled, round(max(alpha), 5) as top from al group by 1",
    "g13_knn_residual": _E + " select query_id, round(sum(alpha * y) - 4.5::double, 5) as residual from al group by 1",
    "g14_listwise_loss": _E
    + """, m as (select *, max(sim) over w as ms, max(rho) over w as mr from n window w as (partition by query_id)), l as (select *, sim - ms - ln(sum(exp(sim - ms)) over w) as ls, rho - mr - ln(sum(exp(rho - mr)) over w) as lt from m window w as (partition by query_id))
      select query_id, round(-sum(exp(lt) * ls), 5) as loss from l group by 1""",
    "g15_pairwise_loss": _E
    + """, x as (select a.query_id, 0.1::double - (a.sim - b.sim) as x from n a join n b on a.query_id = b.query_id and a.rho > b.rho) select query_id, round(avg(greatest(x, 0) + ln(1 + exp(-abs(x)))), 5) as loss, count(*) as pairs from x group by 1""",
    "h1_support_features": _H1 + " select query_id, " + ", ".join(f"round({c}, 5) + 0 as {c}" for c in R.FEATURES) + " from f",
}
