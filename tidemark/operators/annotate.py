"""Annotation jobs around a user's function, and vectors of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def annotate_distinct(rows: DataFrame, column: str, annotator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a batch function on distinct inputs and joins its columns back.

    The function returns the input column, its own columns, ``ok`` and ``reason``; inputs it does not
    return have ``ok`` null.
    """
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.join(distinct.mapInPandas(annotator, schema), column, "left")


def failures(annotated: DataFrame) -> DataFrame:
    """Rows by outcome."""
    return annotated.groupBy(F.when(F.coalesce("ok", F.lit(False)), "ok").otherwise(F.coalesce("reason", F.lit("not_annotated"))).alias("outcome")).agg(F.count("*").alias("n"))


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector", mask: Column | None = None) -> DataFrame:
    """The mean of a key's token vectors where the mask holds, as one array."""
    rows = tokens if mask is None else tokens.where(mask)
    long = rows.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its norm, which counts as at least 1e-12."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def variant_stability(base: DataFrame, variants: DataFrame, owner: str, least: float = 0.99) -> DataFrame:
    """Cosine of each variant with its owner's vector: smallest, mean, share below, verdict."""
    s = variants.select(owner, F.col("vector").alias("_v")).join(base.select(owner, F.col("vector").alias("_b")), owner).select(cosine(F.col("_b"), F.col("_v")).alias("s"))
    out = s.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.avg("s").alias("mean"), F.avg((F.col("s") < least).cast("double")).alias("below"))
    return out.withColumn("verdict", F.when(F.col("n") == 0, "no_variants").when(F.col("low") >= least, "pass").otherwise("fail"))
