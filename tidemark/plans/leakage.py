"""Purging, families, splits and text keys bound to ``documents`` and ``benchmark``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import texts as T
from tidemark.operators import annotate, purge, splits
from tidemark.operators import families as fam
from tidemark.session import cut, table


def keyed(spark, sf):
    """Documents with exact, normal-form and first-line keys."""
    d = table(spark, sf, "documents")
    first = F.element_at(F.split("text", "\n"), 1)
    return d.select(
        "doc_id", "lang", "source", "n_chars", "text",
        F.md5("text").alias("exact_key"), T.normal_key(F.col("text")).alias("normal"), F.when(F.length(first) >= 20, F.md5(first)).alias("skeleton"),
    )


def purged(spark, sf):
    """Documents with their status against the whole benchmark."""
    return purge.purge_texts(keyed(spark, sf), table(spark, sf, "benchmark"))


def c5(spark, sf):
    return purged(spark, sf).select("doc_id", "status")


def passages(spark, sf):
    return purge.shared_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id")


def c6(spark, sf):
    return purge.membership(table(spark, sf, "documents").select("doc_id"), passages(spark, sf), "doc_id", "listed").select("doc_id", "listed")


#: Keys that no two splits may share.
SPLIT_KEYS = ["exact_key", "normal", "skeleton"]


def split_documents(spark, sf):
    """Purged documents, each with its family and split; guards stop the flow. No key of the test split may stand in another."""
    kept = purged(spark, sf).where("status = 'kept'").select("doc_id", "lang", "source", *SPLIT_KEYS)
    out = cut(splits.split_by_family(kept, "doc_id", SPLIT_KEYS))
    purge.assert_zero_overlap(out.where("split = 'test'"), out.where("split <> 'test'"), SPLIT_KEYS)
    return out


def c7(spark, sf):
    d = keyed(spark, sf).select("doc_id", F.col("source").alias("unit_id"))
    held = d.select("unit_id").distinct().select("unit_id", F.when(S.hash_bucket(F.col("unit_id"), 4) == 0, "calib").otherwise("train").alias("split"))
    return purge.visible(d, held, "calib").groupBy("unit_id").agg(F.count("*").alias("n"))


def c8(spark, sf):
    d = keyed(spark, sf)
    return purge.leaking(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), "doc_id", ["lang"], ["exact_key", "normal", "skeleton"])


def c9(spark, sf):
    d = keyed(spark, sf)
    return purge.shared_keys(d.where("doc_id % 5 = 0"), d.where("doc_id % 5 <> 0"), ["exact_key", "normal", "skeleton"]).select("kind", "n", F.array_join("examples", "|").alias("examples"))


def report(spark, sf):
    universe = table(spark, sf, "documents").select(F.col("source").alias("entity_id")).union(table(spark, sf, "region").select("r_name"))
    return purge.purge_report(purged(spark, sf).withColumnRenamed("source", "entity_id"), universe)


def d12(spark, sf):
    return report(spark, sf).withColumn("rate", F.round("rate", 6))


def d12_sizes(spark, sf):
    return purge.purge_sizes(report(spark, sf))


def d15(spark, sf):
    exact, near = F.col("status") == "exact", F.col("n_shared") > 0
    return purge.audit(purged(spark, sf), {"in_exact": exact, "in_passage": near, "in_either": exact | near, "long": F.col("n_chars") > 2000})


def d16(spark, sf):
    b = T.with_windows(table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("exact_key"), "text"), "text", 8, "w").withColumn("w", F.explode_outer("w"))
    return b.agg(F.countDistinct("item_id").alias("n"), F.countDistinct("exact_key").alias("exact"), F.countDistinct("w").alias("passages"))


def d21(spark, sf):
    d = keyed(spark, sf)
    return purge.overlap_gate(d.where("doc_id % 5 = 0"), d.where("doc_id % 5 <> 0"), "normal").withColumn("rate", F.round("rate", 6))


def d18(spark, sf):
    d = keyed(spark, sf)
    return purge.key_overlap(d.where("doc_id % 5 = 0"), d.where("doc_id % 5 <> 0"), "skeleton").withColumn("rate", F.round("rate", 6))


def e1(spark, sf):
    return fam.key_families(keyed(spark, sf).select("doc_id", "exact_key", "normal", "skeleton"), "doc_id", ["exact_key", "normal", "skeleton"]).select("doc_id", "family_id")


def e4(spark, sf):
    return fam.rule_merges(keyed(spark, sf).select("doc_id", "exact_key", "normal", "skeleton"), "doc_id", ["exact_key", "normal", "skeleton"])


def e5(spark, sf):
    f = e1(spark, sf)
    return f.groupBy("family_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("families"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))


def d24(spark, sf):
    return fam.family_summary(e1(spark, sf))


def sets(spark, sf):
    """Documents as sets of hashed windows of five words."""
    return T.with_windows(table(spark, sf, "documents").select(F.col("doc_id").alias("node"), "text"), "text", 5)


def c14(spark, sf):
    return fam.similar_pairs(sets(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def e2(spark, sf):
    return fam.similarity_families(keyed(spark, sf).select("doc_id", "exact_key", "normal"), "doc_id", ["exact_key", "normal"], sets(spark, sf)).select("doc_id", "family_id")


def e6(spark, sf):
    d = keyed(spark, sf).select("doc_id", "exact_key", "normal", "skeleton")
    q, p = fam.joint_families(d.where("doc_id % 5 = 0"), d.where("doc_id % 5 <> 0"), "doc_id", "exact_key", ["normal", "skeleton"])
    return q.select("doc_id", "family_id").unionByName(p.select("doc_id", "family_id"))


def e6_similar(spark, sf):
    """E6 over key and similarity edges."""
    d = cut(keyed(spark, sf).select("doc_id", "exact_key", "normal"))
    texts, sides = table(spark, sf, "documents").select(F.col("doc_id").alias("node"), "text"), ("{} % 5 = 0", "{} % 5 <> 0")
    own = tuple(T.with_windows(texts.where(side.format("node")), "text", 5) for side in sides)
    q, p = fam.joint_families(*[d.where(side.format("doc_id")) for side in sides], "doc_id", "exact_key", ["normal"], sets=own)
    return q.select("doc_id", "family_id").unionByName(p.select("doc_id", "family_id"))


def c15(spark, sf):
    """C15 with a floor: ids divisible by 50 against all rows."""
    s = sets(spark, sf)
    return fam.similar_across(s.where("node % 50 = 0"), s).where("a <> b").select(F.col("a").alias("query_id"), F.col("b").alias("memory_id"), F.round("similarity", 6).alias("similarity"))


def f1(spark, sf):
    d, null = keyed(spark, sf), F.lit(None)
    out = None
    for p in ("T", "X"):
        u = splits.unit_key(p, null, F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source"), null, F.col("lang"))
        part = d.groupBy(F.lit(p).alias("protocol"), u.alias("unit")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    o = table(spark, sf, "orders")
    year = splits.unit_key("A", null, null, null, F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate")), null)
    return out.unionByName(o.groupBy(F.lit("A").alias("protocol"), year.alias("unit")).agg(F.count("*").alias("n")))


def f3(spark, sf):
    return split_documents(spark, sf).select("doc_id", "family_id", "split")


def f4(spark, sf):
    return splits.counts(split_documents(spark, sf), "family_id")


def f5(spark, sf):
    d = keyed(spark, sf).withColumn("split", F.when(S.hash_bucket(F.col("source"), 5) == 0, "test").otherwise("train"))
    return splits.fingerprint(d, "doc_id")


def f6(spark, sf):
    return splits.group_folds(table(spark, sf, "events"), "user_id")


def d23(spark, sf):
    return splits.summary(split_documents(spark, sf), "family_id", "source")


def i1(spark, sf):
    def parity(frames):
        for x in frames:
            n = x["event_type"].str.len()
            yield pd.DataFrame({"event_type": x["event_type"], "length": n, "ok": n > 4, "reason": n.map(lambda k: None if k > 4 else "too_short")})

    return annotate.failures(annotate.annotate_distinct(table(spark, sf, "events").select("event_id", "event_type"), "event_type", parity, "event_type string, length long, ok boolean, reason string"))


def i2(spark, sf):
    return keyed(spark, sf).groupBy("normal").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def i3(spark, sf):
    return T.core_text(table(spark, sf, "documents"), "doc_id", "text")


def i4(spark, sf):
    fp = T.fingerprint(T.words(F.col("text")), 3, 2048)
    return table(spark, sf, "documents").select("doc_id", F.size(fp).alias("n_on"), F.md5(F.array_join(F.transform(fp, lambda x: x.cast("string")), ",")).alias("digest"))


def i5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", *T.descriptors(F.col("text")))
    return d.select("doc_id", "length", "n_words", "n_distinct", "n_lines", *[F.round(c, 6).alias(c) for c in ("word_length", "upper", "digits", "marks", "spaces")])


def i6(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    pooled = annotate.mean_pool(e, "label", mask=F.col("vector").isNotNull())
    return pooled.select("label", F.array_join(F.transform("vector", lambda x: F.format_number(F.round(x, 4) + 0.0, 4)), ",").alias("vector"))


def i7(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))
    moved = e.select("owner", F.transform("vector", lambda x, i: x.cast("double") + 0.01 * F.sin((F.col("owner") + i).cast("double"))).alias("vector"))
    return annotate.variant_stability(e, moved, "owner").select("n", *[F.round(c, 6).alias(c) for c in ("low", "mean", "below")], "verdict")


QUERIES = {
    "c5_purge": c5, "c5_purge_passages": passages, "c6_membership": c6, "c7_visible_pool": c7, "c8_leak_drop": c8, "c9_zero_overlap": c9, "c14_jaccard_join": c14,
    "d12_purge_report": d12, "d12_purge_sizes": d12_sizes, "d15_pool_audit": d15, "d16_blacklist_summary": d16, "d18_key_overlap": d18, "d21_overlap_gate": d21, "d23_split_summary": d23, "d24_family_sizes": d24,
    "e1_key_families": e1, "e2_similarity_families": e2, "e4_rule_merges": e4, "e5_largest_family": e5, "e6_joint_families": e6, "e6_joint_similarity": e6_similar, "c15_similarity_floor": c15,
    "f1_units": f1, "f3_split": f3, "f4_split_counts": f4, "f5_fingerprint": f5, "f6_group_folds": f6,
    "i1_annotate_distinct": i1, "i2_normal_key": i2, "i3_core_key": i3, "i4_set_fingerprint": i4, "i5_descriptors": i5, "i6_mean_pool": i6, "i7_variant_stability": i7,
}

_D = r"""with recursive d as (select *, md5(text) as exact_key, md5(nullif(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '')) as normal,
    case when length(split_part(text, chr(10), 1)) >= 20 then md5(split_part(text, chr(10), 1)) end as skeleton from documents),
  ww as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from documents),
  pv as (select doc_id, unnest(list_distinct(list_transform(range(greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i+1:i+8], ' ')))) as g from ww),
  pb as (select distinct unnest(list_transform(range(greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i+1:i+8], ' '))) as g from (select regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from benchmark)),
  sh as (select doc_id, count(*) as n_shared from pv where g in (select g from pb) group by 1),
  st as (select d.*, coalesce(n_shared, 0) as n_shared, case when exact_key in (select md5(text) from benchmark) then 'exact' when n_shared > 0 then 'passage' else 'kept' end as status from d left join sh using (doc_id)),
  q as (select unnest([{'k': 'exact_key', 'v': exact_key}, {'k': 'normal', 'v': normal}, {'k': 'skeleton', 'v': skeleton}]) as x, doc_id, lang, doc_id % 5 = 0 as isq, status from st),
  k as (select x.k as kind, x.v as value, doc_id, lang, isq, status from q where x.v is not null)"""


def _families(where: str, nodes: str = "d") -> str:
    """Components over shared keys: each node repeatedly takes the smallest label of its neighbours."""
    return f""", m as (select min(doc_id) over (partition by kind, value) as low0, doc_id from k where {where}), e as (select distinct low0 as a, doc_id as b from m where low0 <> doc_id union select distinct doc_id, low0 from m where low0 <> doc_id),
  w as (select doc_id as node, doc_id as low from {nodes} union select e.b, w.low from w join e on e.a = w.node where w.low < e.b),
  fam as (select node as doc_id, min(low) as family_id from w group by 1)"""


_FAM = _D + _families("true")
# every unit in order of size, each to the split that lacks most, in ten-thousandths of a row
_SPLIT = (
    _D
    + _families("status = 'kept'", "(select * from st where status = 'kept')")
    + """, un as (select family_id, count(*) as n from fam group by 1), uo as (select *, row_number() over (order by n desc, md5('7|' || family_id), family_id) as k, sum(n) over () as t from un),
  gr as (select 0::bigint as k, null::bigint as family_id, null::varchar as split, (select max(t) from uo)::hugeint * 2000 as test, (select max(t) from uo)::hugeint * 4800 as train, (select max(t) from uo)::hugeint * 1600 as inn, (select max(t) from uo)::hugeint * 1600 as calib
    union all select k, family_id, s, test - case when s = 'test' then n * 10000 else 0 end, train - case when s = 'train' then n * 10000 else 0 end, inn - case when s = 'inner' then n * 10000 else 0 end, calib - case when s = 'calib' then n * 10000 else 0 end
    from (select uo.k, uo.family_id, uo.n, gr.test, gr.train, gr.inn, gr.calib, case when train >= greatest(test, inn, calib) then 'train' when test >= greatest(inn, calib) then 'test' when inn >= calib then 'inner' else 'calib' end as s from gr join uo on uo.k = gr.k + 1)),
  sp as (select doc_id, family_id, split, source from fam join (select family_id, split from gr where k > 0) using (family_id) join documents using (doc_id))"""
)
_SET = r"""with recursive w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from documents),
  s as (select doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i+1:i+5], ' ')))) as s from w),
  rep as (select doc_id, len(s) as n, min(doc_id) over (partition by s) as rep, s from s where len(s) > 0),
  x as (select doc_id, n, unnest(s) as g from rep where rep = doc_id),
  c as (select a.doc_id as a, b.doc_id as b, count(*) / (a.n + b.n - count(*))::double as j from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n),
  pairs as (select a, b, round(j, 6) as similarity from c where j >= 0.75::double - 1e-12 union all select rep, doc_id, 1::double from rep where rep <> doc_id)"""
_W = r"""with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from documents)"""

ORACLE = {
    "c5_purge": _D + " select doc_id, status from st",
    "c5_purge_passages": _D + " select doc_id, n_shared from sh",
    "c6_membership": _D + " select doc_id, n_shared > 0 as listed from st",
    "c7_visible_pool": "select source as unit_id, count(*) as n from documents where ('0x' || substr(md5(source), 1, 8))::bigint % 4 <> 0 group by 1",
    "c8_leak_drop": _D + " select distinct doc_id from k where not isq and (lang, kind, value) in (select (lang, kind, value) from k where isq)",
    "c9_zero_overlap": _D
    + """, z as (select distinct kind, value from k where isq and (kind, value) in (select (kind, value) from k where not isq)), r as (select *, row_number() over (partition by kind order by value) as i from z)
      select kind, count(*) as n, array_to_string(list_sort(list(value) filter (i <= 10)), '|') as examples from r group by 1""",
    "c14_jaccard_join": _SET + " select a, b, similarity from pairs",
    "d12_purge_report": _D
    + """, u as (select distinct source as entity_id from documents union select r_name from region), n as (select source as entity_id, count(*) filter (status = 'kept') as kept, count(*) filter (status <> 'kept') as dropped from st group by 1)
      select entity_id, coalesce(kept, 0) as kept, coalesce(dropped, 0) as dropped, round(case when coalesce(kept + dropped, 0) > 0 then dropped / (kept + dropped)::double else 0 end, 6) as rate from u left join n using (entity_id)""",
    "d12_purge_sizes": _D
    + """, u as (select distinct source as entity_id from documents union select r_name from region), n as (select entity_id, count(doc_id) filter (status = 'kept') as kept from u left join st on source = entity_id group by 1)
      select count(*) as entities, min(kept) as smallest, count(*) filter (kept = 0) as zero, (list_sort(list(kept)))[count(*) // 2 + 1] as upper_median from n""",
    "d15_pool_audit": _D
    + """, a as (select count(*) as t, count(*) filter (status = 'exact') as ne, count(*) filter (n_shared > 0) as np, count(*) filter (status <> 'kept') as nu, count(*) filter (n_chars > 2000) as nl from st)
      select x.flag, x.n, round(100.0::double * x.n / t, 1) as percent from (select t, unnest([{'flag': 'in_exact', 'n': ne}, {'flag': 'in_passage', 'n': np}, {'flag': 'in_either', 'n': nu}, {'flag': 'long', 'n': nl}]) as x from a)""",
    "d16_blacklist_summary": _D + " select (select count(distinct item_id) from benchmark) as n, (select count(distinct md5(text)) from benchmark) as exact, (select count(*) from pb) as passages",
    "d21_overlap_gate": _D + """, z as (select distinct value from k where isq and kind = 'normal'), y as (select value in (select value from k where not isq and kind = 'normal') as i from z) select count(*) as n, count(*) filter (i) as shared, round(avg(i::int), 6) as rate, avg(i::int) <= 0.05::double as passed from y""",
    "d23_split_summary": _SPLIT + " select split, count(*) as n, count(distinct family_id) as units, count(distinct source) as entities from sp group by 1",
    "d18_key_overlap": _D + """, z as (select distinct value from k where isq and kind = 'skeleton'), y as (select value in (select value from k where not isq and kind = 'skeleton') as i from z) select count(*) as n, count(*) filter (i) as shared, round(avg(i::int), 6) as rate from y""",
    "d24_family_sizes": _FAM + " select size, count(*) as families from (select count(*) as size from fam group by family_id) group by 1",
    "e1_key_families": _FAM + " select doc_id, family_id from fam",
    "e2_similarity_families": _SET
    + r""", n as (select doc_id, md5(text) as exact_key, md5(nullif(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '')) as normal from documents), kk as (select doc_id, 'e' || exact_key as v from n where exact_key is not null union all select doc_id, 'n' || normal from n where normal is not null),
      m as (select min(doc_id) over (partition by v) as low0, doc_id from kk), e1 as (select distinct low0 as a, doc_id as b from m where low0 <> doc_id union select a, b from pairs), e as (select a, b from e1 union select b, a from e1),
      f as (select doc_id as node, doc_id as low from documents union select e.b, f.low from f join e on e.a = f.node where f.low < e.b) select node as doc_id, min(low) as family_id from f group by 1""",
    "e4_rule_merges": _D
    + """, r as (select unnest([1, 2, 3]) as i), kk as (select i, doc_id, kind, value from r join k on list_position(['exact_key', 'normal', 'skeleton'], kind) <= i), m as (select i, min(doc_id) over (partition by i, kind, value) as low0, doc_id from kk),
      e as (select distinct i, low0 as a, doc_id as b from m where low0 <> doc_id union select distinct i, doc_id, low0 from m where low0 <> doc_id), w as (select i, doc_id as node, doc_id as low from documents, r union select w.i, e.b, w.low from w join e on e.i = w.i and e.a = w.node where w.low < e.b),
      f as (select i, node, min(low) as low from w group by 1, 2), n as (select i, count(distinct low) as n from f group by 1 union all select 0, count(*) from documents)
      select (['exact_key', 'normal', 'skeleton'])[a.i] as rule, b.n - a.n as merges from n a join n b on b.i = a.i - 1""",
    "e5_largest_family": _FAM + " select count(*) as families, max(n) as largest, sum(n)::bigint as nodes from (select count(*) as n from fam group by family_id)",
    "e6_joint_families": _D
    + """, fi as (select coalesce(exact_key, '~' || doc_id) as x, arg_min({'node': case when doc_id % 5 = 0 then 'q:' else 'p:' end || doc_id, 'normal': normal, 'skeleton': skeleton}, (doc_id % 5 <> 0, doc_id)) as f from d group by 1),
      kk as (select f.node as node, 'n' || f.normal as v from fi where f.normal is not null union all select f.node, 's' || f.skeleton from fi where f.skeleton is not null), m as (select min(node) over (partition by v) as low0, node from kk),
      e as (select distinct low0 as a, node as b from m where low0 <> node union select distinct node, low0 from m where low0 <> node), w as (select f.node as node, f.node as low from fi union select e.b, w.low from w join e on e.a = w.node where w.low < e.b),
      g as (select node, min(low) as family_id from w group by 1) select doc_id, family_id from d join fi on fi.x = coalesce(exact_key, '~' || doc_id) join g on g.node = fi.f.node""",
    "e6_joint_similarity": r"""with recursive d as (select doc_id, case when doc_id % 5 = 0 then 'q:' else 'p:' end || doc_id as name, md5(text) as x, md5(nullif(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '')) as normal, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from documents),
      n as (select coalesce(x, '~' || name) as x, arg_min({'n': name, 'k': normal, 'w': w}, (doc_id % 5 <> 0, doc_id)) as f from d group by 1),
      s as (select f.n as node, list_sort(list_distinct(list_transform(range(greatest(len(f.w) - 4, 0)), lambda i: array_to_string(f.w[i+1:i+5], ' ')))) as s from n),
      rep as (select node, len(s) as n, min(node) over (partition by s) as rep, s from s where len(s) > 0), g as (select node, n, unnest(s) as g from rep where rep = node),
      c as (select a.node as a, b.node as b, count(*) / (a.n + b.n - count(*))::double as j from g a join g b on a.g = b.g and a.node < b.node group by a.node, b.node, a.n, b.n),
      m as (select min(f.n) over (partition by f.k) as low, f.n as node from n where f.k is not null),
      e0 as (select a, b from c where j >= 0.75::double - 1e-12 union select rep, node from rep where rep <> node union select low, node from m where low <> node), e as (select a, b from e0 union select b, a from e0),
      t as (select f.n as node, f.n as low from n union select e.b, t.low from t join e on e.a = t.node where t.low < e.b), z as (select node, min(low) as family_id from t group by 1)
      select doc_id, family_id from d join n on n.x = coalesce(d.x, '~' || name) join z on z.node = n.f.n""",
    "c15_similarity_floor": _SET.replace("with recursive w", "with w") + """, q as (select doc_id, n, unnest(s) as g from rep where doc_id % 50 = 0), al as (select doc_id, n, unnest(s) as g from rep)
      select q.doc_id as query_id, al.doc_id as memory_id, round(count(*) / (q.n + al.n - count(*))::double, 6) as similarity from q join al on q.g = al.g and q.doc_id <> al.doc_id group by q.doc_id, al.doc_id, q.n, al.n
      having count(*) / (q.n + al.n - count(*))::double >= 0.75::double - 1e-12""",
    "f1_units": """select 'T' as protocol, case when doc_id % 2 = 0 then lang else source end as unit, count(*) as n from documents group by 2 union all select 'X', lang, count(*) from documents group by 2
      union all select 'A', 'year_' || coalesce(case when o_orderkey % 10 <> 0 then year(o_orderdate)::varchar end, 'unknown'), count(*) from orders group by 2""",
    "f3_split": _SPLIT + " select doc_id, family_id, split from sp",
    "f4_split_counts": _SPLIT + " select split, count(*) as n, count(distinct family_id) as units, min(doc_id) as first_id, max(doc_id) as last_id from sp group by 1",
    "f5_fingerprint": "select count(*) as n, sum(('0x' || substr(md5(doc_id::varchar || '=' || case when ('0x' || substr(md5(source), 1, 8))::bigint % 5 = 0 then 'test' else 'train' end), 1, 8))::bigint)::varchar as fingerprint from documents",
    "f6_group_folds": "select user_id, ((row_number() over (order by md5('7:' || user_id), user_id) - 1) % 5)::int as fold from (select distinct user_id from events)",
    "i1_annotate_distinct": "select case when length(event_type) > 4 then 'ok' else 'too_short' end as outcome, count(*) as n from events group by 1",
    "i2_normal_key": _D + " select normal, count(*) as n, min(doc_id) as first from d group by 1 having count(*) > 1",
    "i3_core_key": """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as place, unnest(string_split(text, chr(10))) as line from documents), c as (select line from l group by 1 having count(distinct doc_id) >= 3),
      p as (select doc_id, string_agg(line, chr(10) order by place) filter (line not in (select line from c)) as core, count(*) filter (line in (select line from c)) as n from l group by 1)
      select doc_id, md5(case when coalesce(length(core), 0) < 20 then text else core end) as core_key, case when coalesce(length(core), 0) < 20 then 0 else n end as n_removed from documents join p using (doc_id)""",
    "i4_set_fingerprint": _W
    + """, s as (select doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 2, 0)), lambda i: ('0x' || substr(md5(w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]), 1, 8))::bigint % 2048))) as s from w) select doc_id, len(s)::int as n_on, md5(array_to_string(s, ',')) as digest from s""",
    "i5_descriptors": r"""with t as (select doc_id, coalesce(text, '') as t from documents), w as (select *, length(t) as n, regexp_extract_all(lower(t), '[\p{L}\p{M}\p{N}]+') as w from t),
      c as (select *, len(regexp_replace(t, '[^\p{Lu}]', '', 'g')) as u, len(regexp_replace(t, '[^\p{N}]', '', 'g')) as g, len(regexp_replace(t, '[\p{L}\p{M}\p{N}\s]', '', 'g')) as m, len(regexp_replace(t, '\S', '', 'g')) as s from w)
      select doc_id, n::bigint as length, len(w)::bigint as n_words, len(list_distinct(w))::bigint as n_distinct, len(string_split(t, chr(10)))::bigint as n_lines, round(case when len(w) > 0 then list_sum(list_transform(w, lambda x: length(x))) / len(w)::double else 0 end, 6) as word_length,
        round(case when n > 0 then u / n::double else 0 end, 6) as upper, round(case when n > 0 then g / n::double else 0 end, 6) as digits, round(case when n > 0 then m / n::double else 0 end, 6) as marks, round(case when n > 0 then s / n::double else 0 end, 6) as spaces from c""",
    "i6_mean_pool": "with x as (select label, unnest(range(1, len(embedding) + 1)) as i, embedding from embeddings), a as (select label, i, round(avg(embedding[i]::double), 4) + 0 as v from x group by 1, 2) select label, string_agg(printf('%.4f', v), ',' order by i) as vector from a group by 1",
    "i7_variant_stability": """with v as (select list_transform(embedding, lambda x: x::double) as b, list_transform(embedding, lambda x, i: x::double + 0.01::double * sin((vec_id + i - 1)::double)) as v from embeddings), s as (select list_cosine_similarity(b, v) as s from v)
      select count(*) as n, round(min(s), 6) as low, round(avg(s), 6) as mean, round(avg((s < 0.99::double)::int), 6) as below, case when count(*) = 0 then 'no_variants' when min(s) >= 0.99::double then 'pass' else 'fail' end as verdict from s""",
}
