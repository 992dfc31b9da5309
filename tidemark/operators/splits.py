"""Splits with units as atoms, guards against degenerate ones, and group folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.scalars import md5_number
from tidemark.operators import families as fam
from tidemark.operators.guards import guarded
from tidemark.operators.ranking import global_rank
from tidemark.session import cut

# Target shares.
SHARES = {"test": 0.20, "train": 0.48, "inner": 0.16, "calib": 0.16}


class MissingUnitError(ValueError):
    """Rows have no unit under the protocol."""


class DegenerateSplitError(ValueError):
    """One unit holds nearly everything."""


def unit_key(protocol: str, family: Column, group: Column, entity: Column, year: Column, origin: Column) -> Column:
    """S by family, T by group or else entity, A by year, X by origin (null where unknown)."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    if protocol == "A":
        return F.concat(F.lit("year_"), F.coalesce(year.cast("string"), F.lit("unknown")))
    return {"S": blank(family), "T": F.coalesce(blank(group), blank(entity)), "X": blank(origin)}[protocol]


def assert_units(rows: DataFrame, unit: str, key: str, most: float = 0.80, fatal: bool = True) -> str | None:
    """raises for missing units, and for a unit with more than ``most`` of all rows (or says so)."""
    missing = [r[0] for r in rows.where(F.col(unit).isNull()).select(key).limit(5).collect()]
    if missing:
        raise MissingUnitError(f"no unit: {missing}")
    top = rows.groupBy(unit).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    if top["all"] and top["top"] > most * top["all"]:
        said = f"the largest unit has {top['top']} of {top['all']} rows"
        if fatal:
            raise DegenerateSplitError(said)
        return said
    return None


def greedy_runs(sizes: list[tuple[int, int]], shares: dict[str, float] = SHARES) -> list[tuple[int, int, list[str]]]:
    """the greedy law for ``(size, units)`` pairs, largest size first, as runs ``(size, start, cycle)``.

    Every unit goes to the split that lacks most, ties to the greatest name. Among units of
    one size the splits that lack nearly the same take turns, so the unit with rank ``r`` of its size
    goes to ``cycle[(r - start) % len(cycle)]`` of the last run with ``start <= r``.
    """
    total = sum(n * k for n, k in sizes)
    need = {s: round(share * 10_000) * total for s, share in shares.items()}  # ten-thousandths, so sums are exact
    runs = []
    for size, units in sizes:
        step, at = size * 10_000, 0
        while at < units:
            order = sorted(need, key=lambda s: (need[s], s), reverse=True)
            top = need[order[0]]
            cycle = [s for s in order if need[s] > top - step]
            others = [need[s] for s in order if s not in cycle]
            # whole turns during which no other split comes within one step of the first
            turns = (units - at) // len(cycle)
            if others:
                turns = min(turns, max(0, (top - others[0]) // step - 1))
            if turns == 0:
                cycle, turns = cycle[:1], 1
            runs.append((size, at, cycle))
            for s in cycle:
                need[s] -= turns * step
            at += turns * len(cycle)
    return runs


def assign_units(sizes: DataFrame, unit: str, seed: int = 7, shares: dict[str, float] = SHARES) -> DataFrame:
    """``(unit, split)``: units from the largest, equal ones in a seeded order, each to the split that
    lacks most, ties to the greatest name.

    One law for every number of units: the driver gets one row for each distinct size, not for
    each unit, and returns the turns that the splits take among units of that size.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(unit).cast("string")))
    ranked = global_rank(sizes.select(unit, F.col("n").cast("long").alias("_n"), order.alias("_o")), [F.desc("_n"), F.col("_o"), F.col(unit)], "_r")
    ranked = cut(ranked)
    per = ranked.groupBy("_n").agg(F.count("*").alias("k"), F.min("_r").alias("first")).orderBy(F.desc("_n")).collect()
    runs: dict[int, list] = {}
    for size, start, cycle in greedy_runs([(r["_n"], r["k"]) for r in per], shares):
        runs.setdefault(size, []).append((start, cycle))
    rows = [(r["_n"], r["first"], runs.get(r["_n"], [])) for r in per]
    table = sizes.sparkSession.createDataFrame(rows, "_n long, first long, runs array<struct<start:long,cycle:array<string>>>")
    r = F.col("_r") - F.col("first")
    run = F.element_at(F.filter("runs", lambda x: x["start"] <= r), -1)
    split = F.element_at(run["cycle"], (F.pmod(r - run["start"], F.size(run["cycle"])) + 1).cast("int"))
    return ranked.join(table, "_n").select(unit, split.alias("split"))


def split_by_family(rows: DataFrame, key: str, columns: list[str], seed: int = 7, most_family: float = 0.20, most_unit: float = 0.80, least_nodes: int = 200, shares: dict[str, float] = SHARES) -> DataFrame:
    """``rows`` with ``family_id`` (by shared keys in ``columns``) and ``split``, families as atoms.

    The flow stops on what makes a split meaningless, by measures that are taken while its stages are written: rows without a key have
    no unit (``MissingUnitError``), one key in two rows (``DuplicateNodeError``), a family of more than ``most_family`` of at
    least ``least_nodes`` rows (``PercolationError``; 1.0 turns it off), and a unit of more than ``most_unit`` of all rows
    (``DegenerateSplitError``). ``rows`` is materialised once, without other columns than are given.
    """

    def keyed(m: dict) -> None:
        if m["missing"]:
            raise MissingUnitError(f"{m['missing']} rows without {key}")

    def sized(m: dict) -> None:
        top, every = m["top"] or 0, m["every"] or 0
        if (m["nodes"] or 0) != every:
            raise fam.DuplicateNodeError(f"{key}: {every} rows of {m["nodes"]} keys")
        if most_family < 1.0 and every >= least_nodes and top > most_family * every:
            raise fam.PercolationError(f"largest family: {top} of {every}")
        if every >= least_nodes and top > most_unit * every:
            raise DegenerateSplitError(f"the largest unit has {top} of {every} rows")

    held = guarded(rows, {"missing": F.count_if(F.col(key).isNull())}, keyed)
    assigned = cut(fam.key_families(held, key, columns, check=False))
    sizes = assigned.groupBy("family_id").agg(F.count("*").alias("n"), F.countDistinct(key).alias("_k"))
    sizes = guarded(sizes, {"top": F.max("n"), "every": F.sum("n"), "nodes": F.sum("_k")}, sized)
    return assigned.join(assign_units(sizes, "family_id", seed, shares), "family_id")


def fingerprint(assigned: DataFrame, key: str, split: str = "split") -> DataFrame:
    """order-free: the number of rows and the sum of hashes of ``key=split``."""
    h = md5_number(F.concat(F.col(key).cast("string"), F.lit("="), F.col(split)))
    return assigned.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def group_folds(rows: DataFrame, group: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """``(group, fold)``: groups in a seeded random order, dealt in turn."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    groups = rows.select(group).distinct().withColumn("_o", order)
    ranked = global_rank(groups, [F.col("_o"), F.col(group)], "_r")
    return ranked.select(group, F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int").alias("fold"))


def summary(rows: DataFrame, unit: str, entity: str) -> DataFrame:
    """Rows, units and entities of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(unit).alias("units"), F.countDistinct(entity).alias("entities"))


def counts(rows: DataFrame, unit: str, key: str = "doc_id") -> DataFrame:
    """rows, units, and the smallest and largest id of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(unit).alias("units"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def out_of_fold(rows: DataFrame, folds: DataFrame, group: str, n: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every row scored by the model that was fitted without its fold."""
    with_fold = rows.join(folds, group)
    parts = []
    for k in range(n):
        apply = fit(with_fold.where(F.col("fold") != k))
        parts.append(apply(with_fold.where(F.col("fold") == k)))
    return reduce(DataFrame.unionByName, parts)


def running(column: str, by: str) -> Column:
    """A sum up to the row over a small ordered table."""
    return F.sum(column).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
