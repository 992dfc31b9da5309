"""From raw measurements to one value for each key and entity, with every loss counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.ranking import join_groups, order_statistics
from tidemark.session import cut


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """A2: one row for each key, the one with the greatest ``order``; rows without a key go."""
    rest = [c for c in df.columns if c != key]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(key, "_r.*")


def convert_units(df: DataFrame, allow_mm: bool = False) -> DataFrame:
    """B3 on ``value, unit, mw``: adds ``p`` and ``status``."""
    return df.withColumn("_c", S.convert(F.col("value"), F.col("unit"), F.col("mw"), allow_mm)).select("*", "_c.p", "_c.status").drop("_c")


def spread_status(n: Column, low: Column, high: Column, most: float = 1.5) -> Column:
    return F.when((n > 1) & (high - low > most), "high_spread").otherwise("ok")


def robust_aggregate(df: DataFrame, keys: list[str], value: str = "p", method: str = "median", most: float = 1.5) -> DataFrame:
    """Median (or mean) of repeats, null with status ``high_spread`` if they lie too far apart. Medians come from ordered value
    counts, so a key with very many repeats meets in no task."""
    agg = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("centre")).where("n > 0")
    if method == "median":
        agg = join_groups(agg.drop("centre"), _medians(df, keys, value), keys)
    agg = agg.withColumn("status", spread_status(F.col("n"), F.col("low"), F.col("high"), most))
    return agg.select(*keys, "n", F.when(F.col("status") == "ok", F.col("centre")).alias("p"), "status")


def _medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return order_statistics(df, keys, value, {"centre": ("linear", 0.5)}).select(*keys, "centre")


def reconcile_flag(flag: str) -> Column:
    """D2, as an aggregate: the flag if all rows have it, else none."""
    return F.when(F.min(flag) == F.max(flag), F.min(flag)).otherwise("none")


def merge(measurements: DataFrame, entities: DataFrame, annotations: DataFrame, most: float = 1.5) -> DataFrame:
    """Annotation, entity, unit and spread checks in one plan; every row keeps its first failure.

    ``measurements``: ``exact_key, accession, tax_id, value, unit, relation, mw, source, ingest_order``.
    Returns one row for each (entity, key) with ``p, flag, mixed, n_source_records, source`` and
    ``status``; rows that fail earlier come one each with a null value, so that counts by status add
    up to the input however often tasks are retried.
    """
    m = measurements.join(annotations.select("exact_key", F.lit(True).alias("_known"), "prefix"), "exact_key", "left")
    m = m.join(entities.select("accession", "tax_id", "entity_id"), ["accession", "tax_id"], "left")
    m = convert_units(m).withColumnRenamed("status", "_unit")
    m = m.withColumn("_flag", S.censor_flag(F.col("relation")))
    status = F.when(F.col("_known").isNull(), "no_annotation").when(F.col("entity_id").isNull(), "entity_or_tax_mismatch").when(F.col("_unit") != "ok", F.col("_unit")).otherwise("ok")
    m = cut(m.withColumn("status", status).select("entity_id", "exact_key", "p", "_flag", "source", "ingest_order", "status"))
    ok = m.where("status = 'ok'")
    good = ok.groupBy("entity_id", "exact_key").agg(
        F.count("*").alias("n_source_records"),
        F.min("p").alias("low"),
        F.max("p").alias("high"),
        reconcile_flag("_flag").alias("flag"),
        (F.min("_flag") != F.max("_flag")).alias("mixed"),
        F.min_by("source", "ingest_order").alias("source"),
    )
    good = join_groups(good, _medians(ok, ["entity_id", "exact_key"], "p"), ["entity_id", "exact_key"])
    good = good.withColumn("status", spread_status(F.col("n_source_records"), F.col("low"), F.col("high"), most))
    good = good.select("entity_id", "exact_key", F.when(F.col("status") == "ok", F.col("centre")).alias("p"), "flag", "mixed", "n_source_records", "source", "status")
    none = lambda t: F.lit(None).cast(t)
    bad = m.where("status <> 'ok'").select("entity_id", "exact_key", none("double").alias("p"), none("string").alias("flag"), none("boolean").alias("mixed"), F.lit(1).cast("long").alias("n_source_records"), "source", "status")
    return good.unionByName(bad)


def conversion_report(converted: DataFrame, top: int = 12) -> DataFrame:
    """Rows by status, the converted share, and the units dropped most often, as ``(metric, key, value)``."""
    by_status = converted.groupBy("status").agg(F.count("*").cast("double").alias("value")).select(F.lit("status").alias("metric"), F.col("status").alias("key"), "value")
    rate = converted.agg(F.round(F.avg((F.col("status") == "ok").cast("double")), 6).alias("value")).select(F.lit("convert_rate").alias("metric"), F.lit("").alias("key"), "value")
    dropped = converted.where(F.col("status").isin("ambiguous", "no_mw", "bad_unit")).groupBy(S.normalize_unit(F.col("unit")).alias("key")).agg(F.count("*").cast("double").alias("value"))
    dropped = dropped.orderBy(F.desc("value"), "key").limit(top).select(F.lit("dropped_unit").alias("metric"), "key", "value")
    return by_status.unionByName(rate).unionByName(dropped)


def min_year(queries: DataFrame, sources: DataFrame, key: str, year: str) -> DataFrame:
    """C11: rows with the earliest known year of their key as ``reference_year``."""
    first = sources.groupBy(key).agg(F.min(year).alias("reference_year"))
    return queries.drop("reference_year").join(first, key, "left")
