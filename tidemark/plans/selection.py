"""Relational and selection operators bound to the star schema: suppliers as entities, parts as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import selection as X
from tidemark.sources import scans
from tidemark.session import table


def facts(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_partkey").alias("item"),
        F.log("l_extendedprice").alias("value"),
        (F.col("l_returnflag") == "R").alias("censored"),
    )


def profiles(spark, sf):
    s = table(spark, sf, "supplier")
    p = X.profile(facts(spark, sf)).withColumnRenamed("entity_id", "s_suppkey")
    return s.join(p, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("group_id"), "s_acctbal", F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("censored_frac", F.lit(0.0)).alias("censored_frac"), F.coalesce("std", F.lit(0.0)).alias("std"),
    )


def selected(spark, sf):
    p = profiles(spark, sf)
    p = p.join(X.leaders(p), "group_id")
    rules = {
        "R1_type": F.col("group_id") % 10 == 3,
        "R3_too_few": F.col("n_items") < 500,
        "R4_censored": F.round("censored_frac", 9) >= 0.34,
        "R5_redundant": F.col("leader") != F.col("entity_id"),
        "R6_low_variance": F.round("std", 9) < 0.77,
        "R7_no_sequence": F.col("s_acctbal") < 0,
    }
    return X.select_entities(p, rules, 520)


def a2(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return scans.dimension(o, "o_custkey", ["o_orderstatus"], "o_orderkey")


def a5(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("entity_id"), "value")
    ids = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"))
    return scans.facts(e, "purchase", ids).groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def a9(spark, sf):
    p = table(spark, sf, "part")
    i = F.col("p_partkey")
    wide = p.select(
        "p_partkey",
        F.when(i % 5 == 0, F.lit("")).otherwise(F.when(i % 2 == 0, F.col("p_brand"))).alias("Primary ID of Chain 2"),
        F.when(i % 3 == 0, F.lit(" ")).otherwise(F.when(i % 7 == 0, F.col("p_type"))).alias("Primary ID of Chain 1"),
        F.col("p_name").alias("Secondary ID of Chain 1"),
    )
    return scans.first_of_chains(wide, r"Primary ID of Chain (\d+)", r"Secondary ID of Chain (\d+)", "accession").select("p_partkey", "accession")


def a10(spark, sf):
    return scans.mapping(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment").select("c_nationkey", F.array_join("values", "|").alias("segments"))


def a13(spark, sf):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    return scans.table_counts({n: (lambda n=n: table(spark, sf, n)) for n in names})


def a15(spark, sf):
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    cache = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"))
    return scans.missing_keys(wanted, cache, "key")


def c1(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    return facts(spark, sf).join(p, "item").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"), F.round(F.avg("value"), 6).alias("mean"))


def c12(spark, sf):
    return X.overlap(facts(spark, sf), 50, 0.15)


def c12_top(spark, sf):
    return c12(spark, sf).orderBy(F.desc("overlap"), F.desc("shared"), "a", "b").limit(20)


def c12_same(spark, sf):
    """Pairs of suppliers of one nation: the entities' names are the nations'."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity_id"), F.col("n_name").alias("name"))
    return X.overlap(facts(spark, sf).join(s, "entity_id"), 50, 0.15, name="name")


def c13(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 45 and l_discount > 0").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_name")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region").where("r_name <> 'ASIA'")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
    j = j.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("l_orderkey", "l_linenumber", "l_quantity", "c_name", "p_brand", "s_name", "n_name", "r_name")


def d6(spark, sf):
    return profiles(spark, sf).select("entity_id", "n_items", F.round("censored_frac", 6).alias("censored_frac"), F.round("std", 6).alias("std"))


def d7(spark, sf):
    return selected(spark, sf).select("entity_id", "n_items", F.array_join("reasons", ",").alias("reasons"), "tier")


def d8(spark, sf):
    return X.eliminations(selected(spark, sf))


def d9(spark, sf):
    return X.showcase(selected(spark, sf), 500, ["R4_censored", "R6_low_variance"]).select("entity_id", "n_items", F.array_join("reasons", ",").alias("reasons"))


def d10(spark, sf):
    return X.selected_totals(facts(spark, sf), selected(spark, sf))


def d11(spark, sf):
    return X.leaders(profiles(spark, sf))


def d13(spark, sf):
    sizes = facts(spark, sf).where("censored").groupBy("entity_id").agg(F.count("*").alias("n"))
    return X.size_gate(selected(spark, sf), sizes, 200, "downgrade").select("entity_id", "pool_size", F.array_join("reasons", ",").alias("reasons"), "tier")


def d14(spark, sf):
    return X.scale_audit(facts(spark, sf), [480, 500, 520])


def d17(spark, sf):
    return X.describe(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]).select(
        "l_returnflag", "column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "p10", "p90")]
    )


def e3(spark, sf):
    """Entity groups over two keys: the same name or the same accession."""
    from tidemark.operators.families import key_families

    c = table(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").alias("node"), S.normalize_name(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.round("c_acctbal", 0).cast("int").cast("string")).alias("accession"))
    return key_families(keys, "node", ["name", "accession"]).select("node", "family_id")


def a6(spark, sf):
    """Distinct keys of at least 14 characters: order clerks' keys, some of them blank or short."""
    k = F.col("o_orderkey")
    keys = table(spark, sf, "orders").select(F.when(k % 5 == 0, F.lit(" ")).when(k % 7 == 0, F.lit("short")).otherwise(F.concat(F.lit(" key "), F.col("o_orderpriority"), F.lit(" "), F.col("o_custkey").cast("string"))).alias("raw"))
    return scans.key_list(keys, "raw")


def a7(spark, sf):
    """Flags and a number of each customer's last order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), F.when(k % 3 == 0, " True ").when(k % 3 == 1, "no").alias("glyco"), F.when(k % 4 == 0, "TRUE").alias("sugar"),
        F.when(k % 6 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("likeness"), k,
    )
    return scans.annotated_keys(rows, "key", ["glyco", "sugar"], "likeness", "o_orderkey").select("exact_key", "flag", F.round("likeness", 4).alias("likeness"))


def b10(spark, sf):
    """The name of each brand's first part by key, and its first word."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"), "p_partkey")
    return scans.first_names(p, "key", "name", "p_partkey")


QUERIES = {
    "a6_key_list": a6, "a7_annotated_keys": a7, "b10_first_name": b10,
    "a2_last_wins": a2, "a5_filtered_facts": a5, "a9_chain_coalesce": a9, "a10_mapping_list": a10, "a13_table_counts": a13, "a15_missing_vectors": a15,
    "c1_dim_lookup": c1, "c12_entity_overlap": c12, "c12_same_name": c12_same, "c12_top_overlaps": c12_top, "c13_star_extract": c13,
    "d6_entity_profile": d6, "d7_rule_selection": d7, "d8_elimination_counts": d8, "d9_showcase": d9, "d10_selected_totals": d10, "d11_group_leader": d11,
    "d13_size_gate": d13, "d14_scale_audit": d14, "d17_domain_shift": d17, "e3_entity_groups": e3,
}

_F = "with f as (select l_suppkey as entity_id, l_partkey as item, ln(l_extendedprice) as value, l_returnflag = 'R' as censored from lineitem)"
_P = (
    _F
    + """, i as (select entity_id, item, avg(value) as v, sum(censored::int) as c, count(*) as n from f group by all),
  q as (select entity_id, count(*) as n_items, sum(c) / sum(n)::double as censored_frac, case when count(*) > 1 then stddev_pop(v) else 0 end as std from i group by 1),
  p as (select s_suppkey as entity_id, s_nationkey as group_id, s_acctbal, coalesce(n_items, 0) as n_items, coalesce(censored_frac, 0) as censored_frac, coalesce(std, 0) as std from supplier left join q on s_suppkey = entity_id)"""
)
_S = (
    _P
    + """, g as (select group_id, arg_min(entity_id, (-n_items, entity_id)) as leader from p group by 1),
  s as (select *, list_filter([case when group_id % 10 = 3 then 'R1_type' end, case when n_items < 500 then 'R3_too_few' end, case when round(censored_frac, 9) >= 0.34::double then 'R4_censored' end,
    case when leader <> entity_id then 'R5_redundant' end, case when round(std, 9) < 0.77::double then 'R6_low_variance' end, case when s_acctbal < 0 then 'R7_no_sequence' end], lambda x: x is not null) as reasons from p join g using (group_id)),
  sel as (select *, case when len(reasons) > 0 then 'tier_x' when n_items >= 520 then 'tier1' else 'tier2' end as tier from s)"""
)
_O = _F + """, d as (select distinct entity_id, item from f), n as (select entity_id, count(*) as n from d group by 1 having count(*) >= 50), h as (select * from d join n using (entity_id)),
  o as (select a.entity_id as a, b.entity_id as b, a.n as n_a, b.n as n_b, count(*) as shared from h a join h b on a.item = b.item and a.entity_id < b.entity_id group by all),
  r as (select a, b, n_a, n_b, shared, round(shared / least(n_a, n_b)::double, 4) as overlap from o where shared / least(n_a, n_b)::double >= 0.15::double)"""

ORACLE = {
    "a6_key_list": "with r as (select trim(case when o_orderkey % 5 = 0 then ' ' when o_orderkey % 7 = 0 then 'short' else ' key ' || o_orderpriority || ' ' || o_custkey end) as exact_key from orders) select distinct exact_key from r where length(exact_key) >= 14",
    "a7_annotated_keys": "select o_custkey::varchar as exact_key, arg_max(o_orderkey % 3 = 0 or o_orderkey % 4 = 0, o_orderkey) as flag, round(arg_max({'v': case when o_orderkey % 6 <> 0 then o_totalprice end}, o_orderkey).v, 4) as likeness from orders group by 1",
    "b10_first_name": "with r as (select p_brand as key, p_name as name, row_number() over (partition by p_brand order by p_partkey) as i from part where p_partkey % 4 <> 0) select key, name, split_part(trim(name), ' ', 1) as genus from r where i = 1",
    "a2_last_wins": "select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1",
    "a5_filtered_facts": "select user_id as entity_id, count(*) as n, round(sum(value), 4) as total from events where event_type = 'purchase' and user_id in (select n_nationkey from nation) group by 1",
    "a9_chain_coalesce": "select p_partkey, coalesce(case when p_partkey % 3 <> 0 and p_partkey % 7 = 0 then p_type end, case when p_partkey % 5 <> 0 and p_partkey % 2 = 0 then p_brand end, p_name) as accession from part",
    "a10_mapping_list": "select c_nationkey, array_to_string(list_sort(list(distinct c_mktsegment)), '|') as segments from customer group by 1",
    "a13_table_counts": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    "a15_missing_vectors": "select distinct doc_id as key from documents where doc_id not in (select vec_id from embeddings)",
    "c1_dim_lookup": _F + " select p_brand, count(*) as n, count(distinct entity_id) as entities, round(avg(value), 6) as mean from f join part on item = p_partkey group by 1",
    "c12_entity_overlap": _O + " select * from r",
    "c12_same_name": _O + " select r.* from r join supplier x on x.s_suppkey = r.a join supplier y on y.s_suppkey = r.b where x.s_nationkey = y.s_nationkey",
    "c12_top_overlaps": _O + " select * from r order by overlap desc, shared desc, a, b limit 20",
    "c13_star_extract": """select l_orderkey, l_linenumber, l_quantity, c_name, p_brand, s_name, n_name, r_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on c_nationkey = n_nationkey left join (select * from region where r_name <> 'ASIA') on n_regionkey = r_regionkey
      where l_quantity > 45 and l_discount > 0 and o_orderstatus <> 'P' and c_acctbal > 0""",
    "d6_entity_profile": _P + " select entity_id, n_items, round(censored_frac, 6) as censored_frac, round(std, 6) as std from p",
    "d7_rule_selection": _S + " select entity_id, n_items, array_to_string(reasons, ',') as reasons, tier from sel",
    "d8_elimination_counts": _S + " select reason, count(*) as n from (select unnest(reasons) as reason from sel) group by 1",
    "d9_showcase": _S + " select entity_id, n_items, array_to_string(reasons, ',') as reasons from sel where tier = 'tier_x' and n_items >= 500 and list_has_any(reasons, ['R4_censored', 'R6_low_variance'])",
    "d10_selected_totals": _S + " select count(*) as n_pairs, count(distinct item) as n_items from (select distinct entity_id, item from f where entity_id in (select entity_id from sel where tier <> 'tier_x'))",
    "d11_group_leader": _P + " select group_id, arg_min(entity_id, (-n_items, entity_id)) as leader from p group by 1",
    "d13_size_gate": _S
    + """, z as (select sel.*, coalesce(n, 0) as pool_size from sel left join (select entity_id, count(*) as n from f where censored group by 1) using (entity_id)),
      t as (select *, tier <> 'tier_x' and pool_size < 200 as small, case when tier <> 'tier_x' and pool_size < 200 then case when tier = 'tier1' then 'tier2' else 'tier_x' end else tier end as t2 from z)
      select entity_id, pool_size, array_to_string(case when small and t2 = 'tier_x' then list_append(reasons, 'pool_too_small') else reasons end, ',') as reasons, t2 as tier from t""",
    "d14_scale_audit": _F
    + """, d as (select distinct entity_id, item from f), z as (select d.*, count(*) over (partition by entity_id) as n from d)
      select least, count(distinct entity_id) as entities, count(*) as pairs, count(distinct item) as items from z, (values (480), (500), (520)) c(least) where n >= least group by 1""",
    "d17_domain_shift": """with u as (select l_returnflag, unnest([{'column': 'l_quantity', 'v': l_quantity}, {'column': 'l_extendedprice', 'v': l_extendedprice}, {'column': 'l_discount', 'v': l_discount}]) as x from lineitem),
      v as (select l_returnflag, x['column'] as "column", x['v'] as v from u),
      r as (select *, row_number() over (partition by l_returnflag, "column" order by v) - 1 as i, count(*) over (partition by l_returnflag, "column") as n from v)
      select l_returnflag, "column", count(*) as n, round(avg(v), 4) as mean, round(median(v), 4) as median, round(stddev_pop(v), 4) as std,
        round(max(case when i = floor(0.1::double * (n - 1)) then v end), 4) as p10, round(max(case when i = floor(0.9::double * (n - 1)) then v end), 4) as p90 from r group by 1, 2""",
    "e3_entity_groups": r"""with recursive k as (select c_custkey as node, 'n' || lower(trim(regexp_replace(regexp_replace(c_name, '[^a-zA-Z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g'))) as key from customer
        union all select c_custkey, 'a' || round(c_acctbal, 0)::int from customer where c_custkey % 3 = 0),
      e as (select distinct a.node as a, b.node as b from k a join k b using (key)),
      w as (select node as node, node as low from (select distinct node from k) union select e.b, w.low from w join e on e.a = w.node where w.low < e.b)
      select node, min(low) as family_id from w group by 1""",
}
