"""Distributed rank: a global order without a window that holds everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.session import cut

_ROW = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with places 1, 2, ... in the given total order.

    Rows are dealt out by range and materialised; a row's place is its number within its range
    plus the rows of earlier ranges. Only the ranges' counts meet in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(_ROW)) + 1).drop("_id", "_part", "_before")


def cumulative(df: DataFrame, value: str, counts: list[str], ascending: bool = True) -> DataFrame:
    """Running sums of counts over distinct values in order, for tables too large for one window.

    ``df`` has one row for each value. Adds ``<count>_upto`` including the row itself.
    """
    order = F.col(value).asc() if ascending else F.col(value).desc()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_part", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in counts])
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_part")
    for c in counts:
        out = out.withColumn(f"{c}_upto", F.col(f"_{c}") + F.sum(c).over(local))
    return out.drop("_part", *[f"_{c}" for c in counts])


def join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row for each group; null groups meet, too."""
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(names), same).drop(*names.values())


def cumulative_by(df: DataFrame, by: list[str], value: str, counts: list[str]) -> DataFrame:
    """``cumulative`` within groups: ``df`` has one row for each group and value.

    All rows are ordered together, groups first, and dealt by range; what earlier groups have is
    subtracted, so a group of any size is dealt out.
    """
    order = [F.col(c) for c in (*by, value)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_part", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in counts])
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_part")
    for c in counts:
        out = out.withColumn(f"{c}_upto", F.col(f"_{c}") + F.sum(c).over(local))
    out = cut(out.drop("_part", *[f"_{c}" for c in counts]))
    start = out.groupBy(*by).agg(*[F.min(F.col(f"{c}_upto") - F.col(c)).alias(f"_{c}") for c in counts])
    out = join_groups(out, start, by)
    for c in counts:
        out = out.withColumn(f"{c}_upto", F.col(f"{c}_upto") - F.col(f"_{c}")).drop(f"_{c}")
    return out


def order_statistics(df: DataFrame, by: list[str], value: str, at: dict[str, tuple[str, float]]) -> DataFrame:
    """``(by, n, name ...)``: exact quantiles of a group's values. ``at`` maps a name to ``("lower", q)``, the element at index
    ``floor(q (n - 1))`` of the sorted values, ``("upper", q)``, that at ``floor(q n)``, or ``("linear", q)``, between the two neighbours of ``q (n - 1)``."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    c = cumulative_by(per, by, value, ["_n"])
    total = per.groupBy(*by).agg(F.sum("_n").alias("n"))
    c = join_groups(c, total, by)
    v, upto = F.col(value), F.col("_n_upto")
    element = lambda index: F.min(F.when(upto > index, v))
    picks = []
    for name, (kind, q) in at.items():
        place = F.lit(q) * (F.col("n") - 1)
        if kind == "linear":
            picks += [element(F.floor(place)).alias(f"{name}_a"), element(F.ceil(place)).alias(f"{name}_b")]
        else:
            picks.append(element(F.floor(place if kind == "lower" else F.least(F.lit(q) * F.col("n"), F.col("n") - 1))).alias(name))
    out = c.groupBy(*by, "n").agg(*picks)
    final = []
    for name, (kind, q) in at.items():
        place = F.lit(q) * (F.col("n") - 1)
        final.append((F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (place - F.floor(place))).alias(name) if kind == "linear" else F.col(name))
    return out.select(*by, "n", *final)
