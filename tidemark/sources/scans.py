"""Scans and sinks. Schemas are given, so no scan reads a file twice."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.scalars import clean
from tidemark.operators.measure import last_wins
from tidemark.session import cut


class MissingColumnsError(ValueError):
    """No column of a wide table matches the pattern that is asked for."""


def read_tsv(spark: SparkSession, path: str, columns: list[str], null: str = "n.a.", sep: str = "\t", multi_line: bool = False) -> DataFrame:
    """A1: a text table with header, all strings, trimmed, blanks and the null token as null.

    ``multi_line`` is for files with line ends inside quotes; such files cannot be split.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, maxCharsPerColumn=10_000_000, enforceSchema=False).schema(schema).csv(path)
    return raw.select(*[clean(F.col(c), null).alias(c) for c in columns])


def file_order(df: DataFrame) -> DataFrame:
    """A row order for first-wins and last-wins rules: file, block, row in the block. Directly after a scan."""
    m = F.col("_metadata")
    return df.withColumn("_order", F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")))


def dimension(df: DataFrame, key: str, required: list[str], order: str) -> DataFrame:
    """A2 to A4: rows that have all required columns, the last of each key."""
    return last_wins(df.dropna(subset=[key, *required]), key, order)


def facts(df: DataFrame, kind: str, ids: DataFrame | None = None) -> DataFrame:
    """A5: rows of one kind, of the given entities."""
    kept = df.where(F.col("kind") == kind)
    return kept if ids is None else kept.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def key_list(df: DataFrame, column: str, least: int = 14) -> DataFrame:
    """Distinct keys that are long enough. A gzip file is one split: deal its rows out before."""
    return df.select(F.trim(F.col(column)).alias("exact_key")).where(F.length("exact_key") >= least).distinct()


def annotated_keys(df: DataFrame, key: str, flags: list[str], number: str, order: str) -> DataFrame:
    """Key, whether any flag says true, and a number if it is one; the last row of a key wins."""
    flag = F.lit(False)
    for c in flags:
        flag = flag | F.coalesce(F.lower(F.trim(F.col(c))) == "true", F.lit(False))
    rows = df.select(F.col(key).alias("exact_key"), flag.alias("flag"), F.col(number).try_cast("double").alias(number), order)
    return last_wins(rows, "exact_key", order)


def first_names(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Each key's first non-blank name by ``order`` (the rows' place in their file), and its first word."""
    rows = df.where(F.col(key).isNotNull() & (F.trim(name) != ""))
    first = rows.groupBy(key).agg(F.min_by(name, order).alias("name"))
    return first.select(key, "name", F.split(F.trim("name"), r"\s+")[0].alias("genus"))


def chain_columns(columns: list[str], pattern: str) -> list[str]:
    """Columns that match, by the number in their first group; none is an error."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(pattern, c))]
    if not found:
        raise MissingColumnsError(f"no column matches {pattern}")
    return [c for _, c in sorted(found)]


def first_of_chains(df: DataFrame, primary: str, secondary: str, alias: str) -> DataFrame:
    """The first non-blank of the primary columns, then of the secondary ones."""
    names = chain_columns(df.columns, primary)
    names += [c for c in df.columns if re.fullmatch(secondary, c)]
    return df.withColumn(alias, F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names]))


def mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """A10: a key's distinct values in order. Comment lines go with the reader's ``comment`` option."""
    return df.dropna(subset=[key, value]).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a file: key is the file's stem up to ``_``, headers are left out, empty ones dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: ~x.startswith(">"))
    key = F.split(F.regexp_replace("name", r"\.[^.]*$", ""), "_")[0]
    return raw.select(key.alias("key"), F.array_join(F.transform(lines, lambda x: F.trim(x)), "").alias("sequence")).where("sequence <> ''")


def table_counts(tables: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Rows of each table; -1 for one that cannot be opened."""
    counts, spark, missing = None, SparkSession.active(), []
    for name, open_table in tables.items():
        try:
            one = open_table().agg(F.count("*").alias("n"), F.lit(name).alias("name")).select("name", "n")
        except Exception:  # noqa: BLE001  any reader's error means the same here
            missing.append((name, -1))
            continue
        counts = one if counts is None else counts.unionByName(one)
    lost = spark.createDataFrame(missing, "name string, n long")
    return lost if counts is None else counts.unionByName(lost)


def write_report(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """A result as parquet (dealt by columns), as a tab-separated text table or as JSON lines, published by ``publish``."""

    def write(to: str) -> None:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.option("header", True).option("sep", "\t").csv(to) if fmt == "tsv" else writer.json(to) if fmt == "json" else writer.parquet(to)

    publish(df.sparkSession, path, write)


def write_nested_report(metrics: DataFrame, path: str) -> None:
    """Long rows ``(metric, key, value)`` as one JSON document, a dot in a key opening a level: a report is small, its rows
    meet on the driver. A row without a key is the metric's own value; of repeated rows the last by value counts."""
    out: dict = {}
    for r in metrics.select("metric", "key", "value").orderBy("metric", F.col("key").asc_nulls_first(), "value").collect():
        names = [r["metric"], *(r["key"].split(".") if r["key"] is not None else [])]
        at = out
        for n in names[:-1]:
            at = at.setdefault(n, {}) if isinstance(at.get(n), (dict, type(None))) else at.update({n: {"": at[n]}}) or at[n]
        at[names[-1]] = r["value"]
    text = json.dumps(out, ensure_ascii=False, sort_keys=True)
    frame = metrics.sparkSession.createDataFrame([(text,)], "value string").coalesce(1)
    publish(metrics.sparkSession, path, lambda to: frame.write.text(to))


def write_split(assigned: DataFrame, path: str, unit: str, split: str = "split") -> None:
    """The split as JSON lines ``{unit}``, one folder a split, so that no list of units is ever built."""
    write_report(assigned.select(F.col(unit).alias("unit"), F.col(split).alias("split")).distinct(), path, ["split"], "json")


class UnpublishedError(ValueError):
    """A folder has no manifest: its write was interrupted, or it is not one of these tables."""


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: bool = False) -> bool:
    """Writes beside ``path`` and renames the finished folder to it: readers see the old table or the whole new one, and what an
    interrupted run leaves has another name. The manifest ``_SUCCESS`` goes with the folder.

    With ``keep`` a table that is there already stays, and the new one is dropped; false says so.
    """
    target, fs = _files(spark, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    write(staged)
    made, _ = _files(spark, staged)
    if keep and fs.exists(target):
        fs.delete(made, True)
        return False
    if fs.exists(target):
        fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(made, target) or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, made.getName())):
        inside = spark._jvm.org.apache.hadoop.fs.Path(target, made.getName())  # another run was first: rename went into its folder
        for lost in (inside, made):
            if fs.exists(lost):
                fs.delete(lost, True)
        return False
    return True


def assert_published(spark: SparkSession, path: str) -> None:
    """Raises unless ``path`` is a finished table."""
    mark, fs = _files(spark, f"{path.rstrip('/')}/_SUCCESS")
    if not fs.exists(mark):
        raise UnpublishedError(path)


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that a cache does not hold yet."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def read_cache(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The finished batches of a cache, each key once (from the first batch by name); none if there is none yet. A plain parquet
    table in the folder counts as the first batch."""
    folder, fs = _files(spark, path)
    names = sorted(f.getPath().getName() for f in (fs.listStatus(folder) if fs.exists(folder) else []))
    batches = ["part-*"] * any(n.startswith("part-") for n in names) + [n for n in names if n.startswith("batch-") and ".staged-" not in n]
    if not batches:
        return None
    found = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{n}").withColumn("_batch", F.lit(i)) for i, n in enumerate(batches)])
    if len(batches) == 1:
        return found.drop("_batch")
    rest = [c for c in found.columns if c not in (key, "_batch")]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), "_batch").alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def extend_cache(wanted: DataFrame, path: str, key: str, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Annotates the keys that a parquet cache lacks and reads the cache again.

    A cache is a folder of batches. A batch is named by a digest of its keys and published by rename, so a run that is
    interrupted leaves nothing that counts, one that is repeated adds nothing, and of two runs that overlap either may come
    first; a key that two batches hold counts once.
    """
    spark = wanted.sparkSession
    cache = read_cache(spark, path, key)
    keys = cut(wanted.select(key).where(F.col(key).isNotNull()).distinct() if cache is None else missing_keys(wanted, cache, key))
    h = F.xxhash64(key).cast("decimal(38,0)")
    n, total, other = keys.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64(key, F.lit(1)).cast("decimal(38,0)"))).first()
    if n or cache is None:
        name = hashlib.sha256(f"{n} {total} {other}".encode()).hexdigest()[:32]
        publish(spark, f"{path.rstrip('/')}/batch-{name}", lambda to: annotate(keys).write.parquet(to), keep=True)
    return wanted.join(read_cache(spark, path, key), key, "left")
