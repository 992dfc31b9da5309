"""Measurement operators bound to ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import measure as M
from tidemark.session import table

RELATIONS = ["=", ">", "<", ">=", "~", "?", "="]
UNITS = {"view": "nM", "click": "uM", "purchase": "ug.mL-1", "signup": "%", "error": "mm"}


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as measurements: unit by type, relation and weight by id."""
    e = table(spark, sf, "events")
    unit = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in UNITS.items()], F.lit(""))
    i = F.col("event_id")
    return e.select(
        i.alias("event_id"),
        F.concat(F.lit("KEY"), F.lpad(F.col("user_id").cast("string"), 11, "0"), F.lit("-"), (i % 2).cast("string")).alias("exact_key"),
        (F.col("user_id") % 20).alias("accession"),
        (i % 3).alias("tax_id"),
        "value",
        unit.alias("unit"),
        F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (i % 7 + 1).cast("int")).alias("relation"),
        F.when(i % 5 != 0, 300.0 + i % 200).alias("mw"),
        F.col("event_type").alias("source"),
        F.when(i % 3 != 0, 2000 + i % 24).alias("year"),
        F.col("user_id").alias("user_id"),
        i.alias("ingest_order"),
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").where("n_nationkey < 18")
    return n.select(F.col("n_nationkey").cast("long").alias("accession"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("tax_id"), F.col("n_name").alias("entity_id"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    keys = measurements(spark, sf).where("user_id % 10 <> 0").select("exact_key").distinct()
    return keys.withColumn("prefix", S.prefix_key(F.col("exact_key")))


def b3(spark, sf):
    c = M.convert_units(measurements(spark, sf))
    return c.select("event_id", "unit", F.round("p", 6).alias("p"), "status")


def b4(spark, sf):
    raw = F.concat(F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("relation")), F.lit(" "), F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("value").cast("decimal(12,2)").cast("string")))
    return measurements(spark, sf).withColumn("r", S.parse_relation(raw)).select("event_id", "r.relation", "r.number")


def b5(spark, sf):
    m = measurements(spark, sf)
    flag, known = S.censor_flag(F.col("relation")), S.relation_known(F.col("relation"))
    return m.groupBy("relation", flag.alias("flag"), known.alias("known")).agg(F.count("*").alias("n"))


def b6(spark, sf):
    p = table(spark, sf, "part")
    tail = F.element_at(F.array(F.lit(" (Human)"), F.lit(" from Bos taurus"), F.lit(" (E. coli K12)"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("The "), "p_name", F.lit("/"), F.col("p_brand"), tail)
    return p.groupBy(S.normalize_name(name).alias("name")).agg(F.count("*").alias("n"))


def b8(spark, sf):
    i = F.col("event_id")
    m = measurements(spark, sf)
    core, prefix = F.when(i % 2 == 0, F.concat(F.lit("C"), (i % 10).cast("string"))).otherwise(" "), F.when(i % 3 == 0, S.prefix_key(F.col("exact_key")))
    return m.select("event_id", S.first_key(core, prefix, S.prefix_key(F.col("exact_key"))).alias("key"))


def b9(spark, sf):
    return table(spark, sf, "customer").groupBy(S.hash_bucket(F.col("c_name")).alias("bucket")).agg(F.count("*").alias("n"))


def d1(spark, sf):
    c = M.convert_units(measurements(spark, sf)).where("status = 'ok'")
    return M.robust_aggregate(c, ["exact_key", "unit"]).withColumn("p", F.round("p", 6))


def d2(spark, sf):
    m = measurements(spark, sf).withColumn("flag", S.censor_flag(F.col("relation")))
    return m.groupBy("exact_key", "source").agg(M.reconcile_flag("flag").alias("flag"), (F.min("flag") != F.max("flag")).alias("mixed"))


def d3(spark, sf):
    m = measurements(spark, sf)
    return m.groupBy("exact_key").agg(F.min_by("source", "ingest_order").alias("source"), F.min_by("unit", "ingest_order").alias("unit"), F.count("*").alias("n_source_records"))


def d4(spark, sf):
    m = M.merge(measurements(spark, sf), entities(spark, sf), annotations(spark, sf), most=4.0)
    return m.select("entity_id", "exact_key", F.round("p", 6).alias("p"), "flag", "mixed", "n_source_records", "source", "status")


def d5(spark, sf):
    return M.conversion_report(M.convert_units(measurements(spark, sf)))


def c2(spark, sf):
    j = measurements(spark, sf).join(entities(spark, sf), ["accession", "tax_id"], "left")
    status = F.when(F.col("entity_id").isNull(), "entity_or_tax_mismatch").otherwise("ok")
    return j.groupBy("entity_id", status.alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def c11(spark, sf):
    m = measurements(spark, sf)
    q = m.select("exact_key").distinct()
    return M.min_year(q, m.where("year > 2005"), "exact_key", "year")


QUERIES = {
    "b3_convert_units": b3,
    "b4_parse_relation": b4,
    "b5_censor_flag": b5,
    "b6_normalize_name": b6,
    "b8_key_fallback": b8,
    "b9_hash_bucket": b9,
    "c2_composite_lookup": c2,
    "c11_min_year_backfill": c11,
    "d1_robust_aggregate": d1,
    "d2_flag_reconcile": d2,
    "d3_first_record": d3,
    "d4_merge_pipeline": d4,
    "d5_conversion_report": d5,
}

_M = """with m as (
  select event_id, user_id, 'KEY' || lpad(user_id::varchar, 11, '0') || '-' || (event_id % 2) as exact_key, user_id % 20 as accession, event_id % 3 as tax_id, value,
    case event_type when 'view' then 'nM' when 'click' then 'uM' when 'purchase' then 'ug.mL-1' when 'signup' then '%' when 'error' then 'mm' else '' end as unit,
    (['=', '>', '<', '>=', '~', '?', '='])[event_id % 7 + 1] as relation, case when event_id % 5 <> 0 then (300 + event_id % 200)::double end as mw,
    event_type as source, case when event_id % 3 <> 0 then 2000 + event_id % 24 end as year from events
), c as (
  select *, case unit when 'mm' then 'ambiguous' when '%' then 'bad_unit' when '' then 'bad_unit' else case when not value > 0 then 'nonpositive' when unit = 'ug.mL-1' and mw is null then 'no_mw' else 'ok' end end as status,
    case relation when '>' then 'right' when '>=' then 'right' when '<' then 'left' else 'none' end as flag from m
), p as (
  select *, case when status = 'ok' then -log10(value * case unit when 'nM' then 1e-9::double when 'uM' then 1e-6::double else 1e-3::double / mw end) end as p from c
)"""

_ENT = """, ent as (select n_nationkey::bigint as accession, t::bigint as tax_id, n_name as entity_id from nation, (values (0), (1)) x(t) where n_nationkey < 18)"""

ORACLE = {
    "b3_convert_units": _M + " select event_id, unit, round(p, 6) as p, status from p",
    "b4_parse_relation": _M
    + """ , r as (select event_id, trim(case when event_id % 4 = 0 then '' else relation end || ' ' || case when event_id % 9 = 0 then 'n/a' else value::decimal(12,2)::varchar end) as t from m)
      select event_id, case when regexp_extract(t, '^(>=|<=|>|<)') = '' then '=' else regexp_extract(t, '^(>=|<=|>|<)') end as relation, try_cast(regexp_replace(t, '^(>=|<=|>|<)\\s*', '') as double) as number from r""",
    "b5_censor_flag": _M + " select relation, flag, relation <> '?' as known, count(*) as n from c group by all",
    "b6_normalize_name": r"""select lower(trim(regexp_replace(regexp_replace(replace(replace(replace(x, ' (Human)', ''), ' from Bos taurus', ''), ' (E. coli K12)', ''), '[^a-zA-Z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g'))) as name, count(*) as n
      from (select 'The ' || p_name || '/' || p_brand || ([' (Human)', ' from Bos taurus', ' (E. coli K12)', ''])[p_partkey % 4 + 1] as x from part) group by 1""",
    "b8_key_fallback": _M + " select event_id, case when event_id % 2 = 0 then 'C' || (event_id % 10) else left(exact_key, 14) end as key from m",
    "b9_hash_bucket": "select (concat('0x', substr(md5(c_name), 1, 8))::bigint % 32)::int as bucket, count(*) as n from customer group by 1",
    "c2_composite_lookup": _M + _ENT + " select entity_id, case when entity_id is null then 'entity_or_tax_mismatch' else 'ok' end as status, count(*) as n, round(sum(value), 4) as total from m left join ent using (accession, tax_id) group by all",
    "c11_min_year_backfill": _M + " select exact_key, min(year) filter (year > 2005) as reference_year from m group by 1",
    "d1_robust_aggregate": _M
    + """ , a as (select exact_key, unit, count(*) as n, min(p) as lo, max(p) as hi, quantile_cont(p, 0.5) as mid from p where status = 'ok' group by all)
      select exact_key, unit, n, round(case when n > 1 and hi - lo > 1.5 then null else mid end, 6) as p, case when n > 1 and hi - lo > 1.5 then 'high_spread' else 'ok' end as status from a""",
    "d2_flag_reconcile": _M + " select exact_key, source, case when min(flag) = max(flag) then min(flag) else 'none' end as flag, min(flag) <> max(flag) as mixed from c group by all",
    "d3_first_record": _M + " select exact_key, arg_min(source, event_id) as source, arg_min(unit, event_id) as unit, count(*) as n_source_records from m group by 1",
    "d4_merge_pipeline": _M
    + _ENT
    + """ , j as (select p.* exclude (status), entity_id, case when user_id % 10 = 0 then 'no_annotation' when entity_id is null then 'entity_or_tax_mismatch' else status end as status from p left join ent using (accession, tax_id)),
      g as (select entity_id, exact_key, count(*) as n, min(p) as lo, max(p) as hi, quantile_cont(p, 0.5) as mid, min(flag) as f0, max(flag) as f1, arg_min(source, event_id) as source from j where status = 'ok' group by all)
      select entity_id, exact_key, case when n > 1 and hi - lo > 4.0 then null else round(mid, 6) end as p, case when f0 = f1 then f0 else 'none' end as flag, f0 <> f1 as mixed, n as n_source_records, source, case when n > 1 and hi - lo > 4.0 then 'high_spread' else 'ok' end as status from g
      union all select entity_id, exact_key, null, null, null, 1, source, status from j where status <> 'ok'""",
    "d5_conversion_report": _M
    + """ select 'status' as metric, status as key, count(*)::double as value from c group by 2
      union all select 'convert_rate', '', round(avg((status = 'ok')::int), 6) from c
      union all (select 'dropped_unit', lower(unit) as k, count(*)::double as n from c where status in ('ambiguous', 'no_mw', 'bad_unit') group by 2 order by n desc, k limit 12)""",
}
