"""Entity profiles, rule-based selection and audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import join_groups, order_statistics
from tidemark.session import written

#: Rows or pairs that a task of a counted step gets, about.
ROWS = 2_000_000


class UnknownPolicyError(ValueError):
    """A size policy other than ``exclude`` and ``downgrade``."""


def profile(facts: DataFrame, entity: str = "entity_id", item: str = "item", value: str = "value", censored: str = "censored") -> DataFrame:
    """Distinct items, censored share of raw rows, population deviation of item means."""
    per_item = facts.groupBy(entity, item).agg(F.avg(value).alias("_v"), F.sum(F.col(censored).cast("int")).alias("_c"), F.count("*").alias("_n"))
    out = per_item.groupBy(entity).agg(F.count("*").alias("n_items"), (F.sum("_c") / F.sum("_n")).alias("censored_frac"), F.stddev_pop("_v").alias("std"))
    return out.withColumn("std", F.when(F.col("n_items") > 1, F.col("std")).otherwise(0.0))


def leaders(profiles: DataFrame, group: str = "group_id", entity: str = "entity_id", size: str = "n_items") -> DataFrame:
    """Each group's member with most items, ties to the smallest id."""
    return profiles.groupBy(group).agg(F.max_by(entity, F.struct(F.col(size), -F.col(entity))).alias("leader"))


def select_entities(profiles: DataFrame, rules: dict[str, Column], tier1: int) -> DataFrame:
    """All reasons against each entity, and its tier. ``rules`` names what excludes."""
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    out = profiles.withColumn("reasons", reasons)
    return out.withColumn("tier", F.when(F.size("reasons") > 0, "tier_x").when(F.col("n_items") >= tier1, "tier1").otherwise("tier2"))


def eliminations(selected: DataFrame) -> DataFrame:
    """Entities by reason; one entity may count under several."""
    return selected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def showcase(selected: DataFrame, least: int, shown: list[str]) -> DataFrame:
    """Large excluded entities that have one of the shown reasons."""
    return selected.where((F.col("tier") == "tier_x") & (F.col("n_items") >= least) & F.arrays_overlap("reasons", F.array(*[F.lit(s) for s in shown])))


def selected_totals(facts: DataFrame, selected: DataFrame, entity: str = "entity_id", item: str = "item") -> DataFrame:
    """Pairs and distinct items of the selected entities."""
    pairs = facts.join(selected.where("tier <> 'tier_x'").select(entity), entity, "left_semi").select(entity, item).distinct()
    return pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct(item).alias("n_items"))


def size_gate(entities: DataFrame, sizes: DataFrame, least: int, policy: str = "exclude", entity: str = "entity_id") -> DataFrame:
    """Entities whose pool is too small are excluded, or go down one tier; none has size 0."""
    if policy not in ("exclude", "downgrade"):
        raise UnknownPolicyError(policy)
    e = entities.join(sizes.select(entity, F.col("n").alias("pool_size")), entity, "left").withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))
    small = (F.col("pool_size") < least) & (F.col("tier") != "tier_x")
    lower = F.when(F.col("tier") == "tier1", "tier2").otherwise("tier_x") if policy == "downgrade" else F.lit("tier_x")
    tier = F.when(small, lower).otherwise(F.col("tier"))
    reasons = F.when(small & (tier == "tier_x"), F.array_append("reasons", F.lit("pool_too_small"))).otherwise(F.col("reasons"))
    return e.withColumn("reasons", reasons).withColumn("tier", tier)


def without_excluded(rows: DataFrame, gated: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Rows of entities that stay."""
    return rows.join(gated.where("tier = 'tier_x'").select(entity), entity, "left_anti")


def scale_audit(facts: DataFrame, cuts: list[int], entity: str = "entity_id", item: str = "item") -> DataFrame:
    """For each minimum size: entities, pairs and distinct items."""
    pairs = facts.select(entity, item).distinct()
    sized = pairs.join(pairs.groupBy(entity).agg(F.count("*").alias("_n")), entity)
    at = sized.withColumn("least", F.explode(F.array(*[F.lit(c) for c in cuts]))).where("_n >= least")
    return at.groupBy("least").agg(F.countDistinct(entity).alias("entities"), F.count("*").alias("pairs"), F.countDistinct(item).alias("items"))


def overlap(facts: DataFrame, least_items: int, least_share: float, entity: str = "entity_id", item: str = "item", name: str | None = None, rows: int = ROWS) -> DataFrame:
    """Pairs of entities by shared items over the smaller one's items. Only pairs that share an item are made;
    with ``name``, only those of entities that have the same non-blank name.

    An item's entities stand in a list by size; each of them is sent with those after it, to the task that counts all its pairs. So that no
    task counts more than about ``rows`` pairs, the number of tasks follows the counted pairs.
    """
    few = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda n: max(few, math.ceil((n or 0) / rows))
    keys = [entity, item] + ([name] if name else [])
    n = tasks(facts.count())
    pairs = facts.select(*keys).repartition(n, entity, item).distinct()
    size = pairs.groupBy(entity).agg(F.count("*").alias("n")).where(F.col("n") >= least_items)
    held = pairs.join(size, entity).select(F.col("n"), F.col(entity).alias("e"), F.col(item).alias("i"), *([F.nullif(F.trim(name), F.lit("")).alias("_name")] if name else []))
    by = ["i"] + (["_name"] if name else [])
    held = held.dropna(subset=["e", *by]).repartition(n, *by)
    lists = written(held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("l")).where(F.size("l") > 1).select("l"))
    made = tasks(lists.agg(F.sum(F.size("l").cast("long") * (F.size("l") - 1) / 2)).first()[0])
    each = lists.select(F.posexplode("l").alias("at", "x"), "l").where(F.col("at") + 1 < F.size("l"))
    each = each.select("x.e", "x.n", F.slice(F.col("l.e"), F.col("at") + 2, F.size("l")).alias("others")).repartition(made, "e")
    shared = each.select("e", "n", F.explode("others").alias("o")).groupBy("e", "n", "o").agg(F.count("*").alias("shared")).where(F.col("shared") / F.col("n") >= least_share)
    shared = shared.join(size.select(F.col(entity).alias("o"), F.col("n").alias("n_o")), "o")
    first, share = F.col("e") < F.col("o"), F.round(F.col("shared") / F.col("n"), 4)
    ends = [F.when(first, x).otherwise(y).alias(c) for c, x, y in (("a", F.col("e"), F.col("o")), ("b", F.col("o"), F.col("e")), ("n_a", F.col("n"), F.col("n_o")), ("n_b", F.col("n_o"), F.col("n")))]
    return shared.select(*ends, "shared", share.alias("overlap"))


def describe(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """For each side and numeric column: n, mean, median, deviation, lower-index deciles.

    The deciles are elements of the sample: of n sorted values, those at index ``floor(q (n - 1))``.
    Value counts of all columns are ordered together, dealt by range.
    """
    long = df.select(side, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x")).select(side, "_x.*").where("v is not null")
    by = [side, "column"]
    picks = order_statistics(long, by, "v", {"median": ("linear", 0.5), "p10": ("lower", 0.1), "p90": ("lower", 0.9)})
    stats = long.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return join_groups(picks, stats, by).select(*by, "n", "mean", "median", "std", "p10", "p90")
