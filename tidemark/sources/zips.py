"""A source of delimited tables in zip archives: one partition a member, only the asked columns parsed."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a member parsed at once.
BLOCK = 4 << 20


def _open(path: str):
    """The archive, from any file system that Arrow knows; members are read by seeking, never as a whole."""
    if "://" not in path:
        return zipfile.ZipFile(path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return zipfile.ZipFile(fs.open_input_file(inner))


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str], suffix: str, sep: str, schema: StructType):
        self.paths, self.suffix, self.sep, self.names = paths, suffix, sep, schema.fieldNames()

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            with _open(path) as z:
                found += [Member(path, i.filename) for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)]
        return found or [Member("", "")]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with _open(part.path) as z, z.open(part.name) as raw:
            head = next(csv.reader(io.StringIO(raw.readline().decode("utf-8-sig")), delimiter=self.sep, quoting=csv.QUOTE_NONE), [])
            have = [n for n in self.names if n in head]
            if not raw.peek(1):  # nothing but a header
                return
            kinds = {n: pa.string() for n in have}
            with pacsv.open_csv(
                raw,
                read_options=pacsv.ReadOptions(column_names=head, block_size=BLOCK),
                parse_options=pacsv.ParseOptions(delimiter=self.sep, quote_char=False),
                convert_options=pacsv.ConvertOptions(include_columns=have, column_types=kinds, strings_can_be_null=True, null_values=[""]),
            ) as table:
                for batch in table:
                    cols = [batch.column(n) if n in have else pa.nulls(batch.num_rows, pa.string()) for n in self.names]
                    yield pa.RecordBatch.from_arrays(cols, names=self.names)


class ZipTables(DataSource):
    """``spark.read.format("zip_tables").option("columns", ...).load(path)``; see ``read_zip``."""

    @classmethod
    def name(cls) -> str:
        return "zip_tables"

    def schema(self) -> StructType:
        asked = self.options.get("columns")
        names = asked.split("\x1f") if asked else header(self._paths(), self.options.get("suffix", ".tsv"), self.options.get("sep", "\t"))
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self._paths(), self.options.get("suffix", ".tsv"), self.options.get("sep", "\t"), schema)

    def _paths(self) -> list[str]:
        return self.options["archives"].split("\x1f")


def header(paths: list[str], suffix: str = ".tsv", sep: str = "\t") -> list[str]:
    """The columns of all members in the order in which they first appear; only first lines are read."""
    found: dict[str, None] = {}
    for path in paths:
        with _open(path) as z:
            for i in z.infolist():
                if not i.is_dir() and i.filename.endswith(suffix):
                    with z.open(i) as raw:
                        line = raw.readline().decode("utf-8-sig").rstrip("\r\n")
                        found |= dict.fromkeys(line.split(sep) if line else [])
    return list(found)


def read_zip(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, suffix: str = ".tsv", sep: str = "\t") -> DataFrame:
    """The delimited members of zip archives as one table of strings (empty: null), unquoted.

    A member is a partition, parsed block by block; of its columns only ``columns`` are decoded (all without them), and those it
    lacks are null. Archives lie where Arrow's file systems reach from every machine. An archive without such members has no rows.
    """
    paths = [paths] if isinstance(paths, str) else paths
    spark.dataSource.register(ZipTables)
    reader = spark.read.format("zip_tables").option("archives", "\x1f".join(paths)).option("suffix", suffix).option("sep", sep)
    return (reader.option("columns", "\x1f".join(columns)) if columns else reader).load()
