"""Mixing sources to target weights by systematic sampling (native Spark SQL only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.batches import aside
from tidemark.session import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Size classes to an octave: documents of a class differ by less than a tenth in size.
CLASSES = 8
#: Bits of the hash by which a size class is cut into ranges, at least, and rows that a range of a class that
#: holds all rows would have, about: so no window holds a whole source, however large.
CHUNK_BITS, CHUNK_ROWS = 6, 50_000
#: The random offset is a multiple of this, so that whole rates add up exactly.
STEPS = 1024


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*cols: Column) -> Column:
    """60 random bits as a long, from md5, which every engine has; null counts as a text of its own."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code point order, null last, take the weights in turn. All targets add up to
    ``share`` of all sizes; a target stops at ``most`` times its source's size and the excess
    is shared again by weight. With sources ordered by the level at which they fill up, the
    sources that fill are a prefix, so one running sum gives the final level: no loop.
    The table has one row a source, so its windows are small however many rows there are.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = total.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("all", share * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    # the level if exactly the sources before this one were full; the first that holds is the level
    s = s.withColumn("level", (F.col("all") - F.col("full")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id", **shares) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Within a source the rows stand in order of size class and then of a hash of their id and text; a
    running count times the source's rate (target over size, at most 2) is the prefix sum of
    expected copies; with one random offset a source, a row is emitted once for each whole
    number its interval crosses. The order makes the sample follow the source's size
    distribution, so the words taken come near the target.

    The prefix sum has three levels (size class, hash range, row); ranges are as many as the
    counted rows ask for, so a source that holds most rows is still dealt out, and only equal rows
    are never told apart. Rows are shuffled once. A null text has size 0; null sources are one source;
    equal rows share their copies in any order; an empty table gives an empty result; a very long
    text is one row. Columns of ``docs`` are kept, whatever their names; those with a name that
    this operator makes are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in made or c in (text, source, key)]
    return aside(docs, (text, source, key), made, lambda d: _mix(d, seed, text, source, key, **shares)).select(*kept, *[c for c in made if c not in kept])


def _mix(d: DataFrame, seed: int, text: str, source: str, key: str, **shares) -> DataFrame:
    bits = max(CHUNK_BITS, (d.count() // CHUNK_ROWS).bit_length())
    h = draw(F.col(key), F.md5(F.col(text)), F.lit(seed))
    klass = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * CLASSES)).otherwise(-1).cast("long")
    d = d.withColumn("size", words(F.col(text)))
    d = d.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~"))).withColumn("_h", h)
    d = d.withColumn("_k", klass).withColumn("_c", F.shiftright("_h", 60 - bits))
    # materialised, as three branches read it and the texts should be scanned for it once
    cells = cut(d.groupBy(F.col(source).alias("source"), "_s", "_k", "_c").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    targets = source_targets(cells, **shares)
    # rows before a size class, then rows before a hash range of it
    by_class = cells.groupBy("source", "_s", "_k").agg(F.sum("n").alias("kn"))
    over = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.select("_s", "_k", F.coalesce(F.sum("kn").over(over), F.lit(0)).alias("k_before"))
    over = Window.partitionBy("_s", "_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offset = cells.select("source", "_s", "_k", "_c", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("c_before"))
    offset = offset.join(by_class, ["_s", "_k"]).join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")))
    offset = offset.select("_s", "_k", "_c", (F.col("k_before") + F.col("c_before")).alias("before"), "source_size", "target")
    within = Window.partitionBy("_s", "_k", "_c").orderBy("_h", F.col(key).asc_nulls_last(), "size")
    d = d.withColumn("_r", F.row_number().over(within)).join(offset, ["_s", "_k", "_c"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.pmod(draw(F.col("_s"), F.lit(seed)), F.lit(STEPS)) / F.lit(float(STEPS))
    rank = F.col("before") + F.col("_r")
    crossed = F.floor(rate * rank + at) - F.floor(rate * (rank - 1) + at)
    d = d.withColumn("copies", F.least(F.lit(2), F.greatest(F.lit(0), crossed)).cast("long"))
    return d.withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it was drawn."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


OP2_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    coalesce('=' || source, '~') as s,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '~') || ':' || coalesce(md5(text), '~') || ':7'), 1, 15))::bigint as h
  from documents
), t0 as (
  select s, source, sum(size)::bigint as source_size from d group by all
), t1 as (
  select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w,
    2.0::double * source_size as cap from t0
), t2 as (
  select *, cap / w as fills, 1.5::double * sum(source_size) over () as whole from t1
), t3 as (
  select *, (whole - coalesce(sum(cap) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from t2
), t4 as (
  select s, source_size, least(cap, coalesce((select min_by(level, fills) from t3 where level <= fills) * w, cap)) as target from t3
), r as (
  select d.*, row_number() over (partition by s order by case when size > 0 then floor(log2(size::double) * 8) else -1 end, h, doc_id nulls last, size) as k from d
), c as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0::double end as rate, k,
    (('0x' || substr(md5(s || ':7'), 1, 15))::bigint % 1024) / 1024::double as u from r join t4 using (s)
)
select doc_id, size, source_size, target, (floor(rate * k + u) - floor(rate * (k - 1) + u))::bigint as copies,
  ((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size)::bigint as taken from c
"""
