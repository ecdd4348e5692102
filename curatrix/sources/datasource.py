"""The catalog as a data source: spark.read.format("curatrix") with the options path, relation and, for an older one, commit.

A reader keeps to one commit, has a task for each file, reads the columns that are asked for, and leaves out row groups by the
filters that are pushed. A writer's tasks write files of a new version, and its commit is the catalog's next number, which can be
taken once: of two writers one is told, and its files go. Paths are those that pyarrow's file systems open; the catalog's own
reader, which is Spark's, has no such bound.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from curatrix.schemas import PARTED, RELATIONS
from curatrix.sources.versions import Conflict

NAME = "curatrix"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _commit(files: fs.FileSystem, root: str, number: int | None) -> tuple[int, dict]:
    """A commit's number and what it says; 0 and nothing where there is none yet."""
    if number is None:
        found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
        number = max((int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")), default=0)
    if not number:
        return 0, {"versions": {}, "parts": {}}
    with files.open_input_stream(f"{root}/commits/{number:012d}.json") as f:
        return number, json.loads(f.read())


def _arrow(of: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(of)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return (RELATIONS | PARTED)[self.options["relation"]]

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> CatalogWriter:
        if not overwrite:
            raise ValueError("a version replaces the one before: write with mode overwrite")
        return CatalogWriter(self.options, schema)


@dataclass
class FilePart(InputPartition):
    path: str


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.uri, self.relation, self.schema = options["path"], options["relation"], schema
        self.filters: list = []
        files, root = fs.FileSystem.from_uri(self.uri)
        self.number, said = _commit(files, root, int(options["commit"]) if "commit" in options else None)
        version = said["versions"].get(self.relation)
        self.folders = [f"{root}/{self.relation}/version={version}"] if version else []
        self.folders += [f"{root}/{self.relation}/version={v}/part={p}" for v, parts in said["parts"].get(self.relation, {}).items() for p in parts]

    def pushFilters(self, filters: list) -> Iterator:
        """Take what a row group's bounds can tell; the rest stays Spark's, times too, as files may hold them in two ways."""
        timed = {f.name for f in _arrow(self.schema) if pa.types.is_timestamp(f.type)}
        for f in filters:
            column = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] not in timed
            if column and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull, StringStartsWith)):
                self.filters.append(f)
            else:
                yield f

    def _expression(self) -> pc.Expression | None:
        kinds = {f.name: f.type for f in _arrow(self.schema)}
        whole = None
        for f in self.filters:
            name = f.attribute[0]
            value = lambda v, name=name: pa.scalar(v, kinds[name])
            c = pc.field(name)
            match f:
                case EqualTo():
                    e = c == value(f.value)
                case GreaterThan():
                    e = c > value(f.value)
                case GreaterThanOrEqual():
                    e = c >= value(f.value)
                case LessThan():
                    e = c < value(f.value)
                case LessThanOrEqual():
                    e = c <= value(f.value)
                case In():
                    e = c.isin(pa.array([v for v in f.value if v is not None], kinds[name]))
                case IsNull():
                    e = c.is_null()
                case IsNotNull():
                    e = c.is_valid()
                case _:
                    e = pc.starts_with(c, f.value)
            whole = e if whole is None else whole & e
        return whole

    def partitions(self) -> list[FilePart]:
        files, _ = fs.FileSystem.from_uri(self.uri)
        found = [i.path for folder in self.folders for i in files.get_file_info(fs.FileSelector(folder)) if i.base_name.endswith(".parquet")]
        return [FilePart(p) for p in sorted(found)] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = fs.FileSystem.from_uri(self.uri)
        want = _arrow(self.schema)
        there = ds.dataset(partition.path, filesystem=files, format="parquet").schema
        # Files of before a column was added have nulls there.
        table = ds.dataset(partition.path, filesystem=files, format="parquet", schema=pa.schema([pa.field(f.name, there.field(f.name).type if f.name in there.names else f.type) for f in want]))
        for batch in table.scanner(columns=want.names, filter=self._expression()).to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in want], schema=want)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class CatalogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.uri, self.relation = options["path"], options["relation"]
        if self.relation not in RELATIONS:
            raise ValueError(f"{self.relation} is not written as a whole")
        self.schema = _arrow(schema)
        files, root = fs.FileSystem.from_uri(self.uri)
        self.number, self.said = _commit(files, root, int(options["commit"]) if "commit" in options else None)
        self.version = f"{self.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        self.folder = f"{root}/{self.relation}/version={self.version}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        files, _ = fs.FileSystem.from_uri(self.uri)
        files.create_dir(self.folder, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.parquet", 0  # of its own for each attempt
        with pq.ParquetWriter(f"{self.folder}/{name}", self.schema, filesystem=files) as out:
            for batch in iterator:
                out.write_batch(batch.cast(self.schema) if batch.schema != self.schema else batch)
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        """Only the files of the attempts that count stay, and then the number is taken."""
        files, root = fs.FileSystem.from_uri(self.uri)
        files.create_dir(self.folder, recursive=True)
        counted = {m.name for m in messages if m}
        for info in files.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name not in counted:
                files.delete_file(info.path)
        text = json.dumps({"versions": self.said["versions"] | {self.relation: self.version}, "parts": self.said["parts"]})
        files.create_dir(f"{root}/commits", recursive=True)
        aside, named = f"{root}/commits/.{self.version}", f"{root}/commits/{self.number + 1:012d}.json"
        with files.open_output_stream(aside) as out:
            out.write(text.encode())
        try:
            if isinstance(files, fs.LocalFileSystem):
                os.link(aside, named)
                files.delete_file(aside)
            elif files.get_file_info(named).type != fs.FileType.NotFound:
                raise FileExistsError(named)
            else:
                files.move(aside, named)
        except FileExistsError:
            files.delete_file(aside)
            files.delete_dir(self.folder)
            raise Conflict(f"commit {self.number + 1} is taken") from None

    def abort(self, messages: list) -> None:
        files, _ = fs.FileSystem.from_uri(self.uri)
        if files.get_file_info(self.folder).type == fs.FileType.Directory:
            files.delete_dir(self.folder)
