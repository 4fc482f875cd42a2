"""Zipped month files as a data source: a partition per member of a zip, of which only the wanted columns and airports are read.

Files are opened through Arrow's file systems, on the executors a member at a time.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

NAME = "month_zips"
ENCODING = "ISO-8859-1"
ENDS = ("Origin", "Dest")
BLOCK = 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1)
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def zips(path: str) -> list[str]:
    """The zip files of a folder and the folders below, or the file itself, as paths of its file system."""
    files, root = opened(path)
    if files.get_file_info(root).type == pyarrow.fs.FileType.File:
        return [root]
    return sorted(f.path for f in files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and f.path.lower().endswith(".zip"))


class Member(InputPartition):
    def __init__(self, source: str, path: str, name: str, size: int):
        self.source, self.path, self.name, self.size = source, path, name, size


class Wanted(NamedTuple):
    """Which rows: those that touch one of the airports, and of each column those with one of its values."""

    airports: tuple[str, ...]
    values: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def columns(self) -> set[str]:
        return {c for c, _ in self.values} | (set(ENDS) if self.airports else set())

    def kept(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for column, values in self.values:
            batch = batch.filter(pc.is_in(batch.column(column), pa.array(values, pa.string())))
        if self.airports:
            origin, dest = (pc.is_in(batch.column(c), pa.array(self.airports, pa.string())) for c in ENDS)
            batch = batch.filter(pc.or_(origin, dest))
        return batch


class MonthReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], airports: tuple[str, ...]):
        self.paths, self.columns, self.wanted = paths, columns, Wanted(airports, ())

    def partitions(self) -> list[Member]:
        """The CSV members of all zips, the largest first."""
        found = []
        for source in self.paths:
            files, _ = opened(source)
            for path in zips(source):
                with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as held:
                    found += [Member(source, path, m.filename, m.file_size) for m in held.infolist() if m.filename.lower().endswith(".csv")]
        return sorted(found, key=lambda m: -m.size)

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        read = list(dict.fromkeys([*self.columns, *sorted(self.wanted.columns)]))
        kinds = pa.csv.ConvertOptions(include_columns=read, include_missing_columns=True, column_types=dict.fromkeys(read, pa.string()), strings_can_be_null=True, null_values=[""])
        files, _ = opened(member.source)
        with files.open_input_file(member.path) as raw, zipfile.ZipFile(raw) as held, held.open(member.name) as text:
            if member.size == 0:
                return
            reader = pa.csv.open_csv(text, pa.csv.ReadOptions(encoding=ENCODING, block_size=BLOCK), pa.csv.ParseOptions(newlines_in_values=True), kinds)
            for batch in reader:
                yield self.wanted.kept(batch).select(self.columns)


class FilteringReader(MonthReader):
    """Takes what the query asks of single columns, where the session lets sources do so."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        values = []
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                some = (f.value,) if isinstance(f, EqualTo) else f.value
                values.append((f.attribute[0], tuple(str(v) for v in some if v is not None)))
            else:
                yield f
        self.wanted = self.wanted._replace(values=tuple(values))


class MonthZips(DataSource):
    """Options: paths (one a line), airports (separated by commas; rows that start or end at one), filters (whether pushed filters are taken)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """All columns of the first member that has a header."""
        paths = self.options["paths"].split("\n")
        for member in MonthReader(paths, [], ()).partitions():
            files, _ = opened(member.source)
            with files.open_input_file(member.path) as raw, zipfile.ZipFile(raw) as held, held.open(member.name) as text:
                header = next(csv.reader(io.TextIOWrapper(text, ENCODING)), [])
            if header:
                return StructType([StructField(c, StringType()) for c in header if c])
        raise FileNotFoundError(f"no month files in {paths}")

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteringReader if self.options.get("filters") == "true" else MonthReader
        airports = tuple(a for a in self.options.get("airports", "").split(",") if a)
        return kind(self.options["paths"].split("\n"), schema.names, airports)


def read_zips(spark: SparkSession, paths: list[str], columns: list[str], airports: list[str] | None = None) -> DataFrame:
    """`columns` of all CSV members of zip files as text, matched by header name; empty cells and columns a member hasn't got are null.

    Rows that touch none of `airports` are left out where they are read. So are rows that a filter on one column leaves out, if the session has
    spark.sql.python.filterPushdown.enabled.
    """
    spark.dataSource.register(MonthZips)
    schema = StructType([StructField(c, StringType()) for c in columns])
    pushed = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format(NAME).schema(schema).options(paths="\n".join(paths), airports=",".join(airports or []), filters=pushed).load()


def write_zips(rows: DataFrame, folder: str, month: str) -> DataFrame:
    """Month files as they are published: a zip for each task, in it a CSV member per month of its rows. Returns (file, member, rows) when read.

    Rows are sorted by month in each task and written as a stream; a file of a task that ran twice is written over.
    """
    names = [c for c in rows.columns if c != month]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        file, done = f"months-{TaskContext.get().partitionId():05d}.zip", []
        with files.open_output_stream(f"{root}/{file}", compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as held:
            member, text, writer = None, None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if member != f"{row[month]}.csv":
                        if text:
                            text.close()
                        member = f"{row[month]}.csv"
                        text = io.TextIOWrapper(held.open(member, "w", force_zip64=True), ENCODING, errors="replace", newline="")
                        writer = csv.writer(text)
                        writer.writerow(names)
                        done.append([file, member, 0])
                    writer.writerow(["" if row[c] is None else row[c] for c in names])
                    done[-1][2] += 1
            if text:
                text.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["file", "member", "rows"])

    return rows.sortWithinPartitions(month).mapInArrow(run, "file string, member string, rows long")
