"""Listing landing and staging folders.

``binaryFile`` hides names starting with ``_`` or ``.`` and zero-byte files, which the exchange
has to count, so listing has its own source. It reads metadata only: payloads are opened later,
after the files have been spread over the cluster.
"""

from __future__ import annotations

import json
import operator
import time
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from sealroute.sources.commit import commit, discard, new_job, record, stage
from sealroute.sources.storage import locate, walk

MANIFEST = StructType([
    StructField("path", StringType()),
    StructField("name", StringType()),
    StructField("length", LongType()),
    StructField("modified", TimestampType()),
    StructField("is_dir", BooleanType()),
])
PAYLOAD = "path string, content binary"
BATCH_ROWS = 4096
POLL_TASKS = 1000


def _entry(info: pafs.FileInfo, path: str) -> tuple:
    is_dir = info.type == pafs.FileType.Directory
    return (path, info.base_name, None if is_dir else info.size, info.mtime, is_dir)


class FolderPartition(InputPartition):
    def __init__(self, *folders: str):
        super().__init__(folders)
        self.folders = folders


#: Filters that are tested while a folder is listed; a missing value passes none but the test for it.
TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, In: lambda held, values: held in values, StringStartsWith: str.startswith,
    StringEndsWith: str.endswith, StringContains: operator.contains,
}


class LandingReader(DataSourceReader):
    """Lists folders, one task each, and keeps only the entries that the filters on name, length and kind pass."""

    def __init__(self, folders: list[str], recursive: bool):
        self.folders = folders
        self.recursive = recursive
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            inner = one.child if isinstance(one, Not) else one
            if type(inner) in (*TESTS, IsNull, IsNotNull) and inner.attribute in (("name",), ("length",), ("is_dir",)):
                self.filters.append(one)
            else:
                yield one

    def passes(self, info: pafs.FileInfo) -> bool:
        is_dir = info.type == pafs.FileType.Directory
        held = {("name",): info.base_name, ("length",): None if is_dir else info.size, ("is_dir",): is_dir}

        def test(one: Filter) -> bool:
            value = held[one.attribute]
            if isinstance(one, (IsNull, IsNotNull)):
                return (value is None) == isinstance(one, IsNull)
            return value is not None and TESTS[type(one)](value, one.value)

        def passed(one: Filter) -> bool:
            if not isinstance(one, Not):
                return test(one)
            known = isinstance(one.child, (IsNull, IsNotNull)) or held[one.child.attribute] is not None
            return known and not test(one.child)

        return all(map(passed, self.filters))

    def partitions(self) -> list[FolderPartition]:
        return [FolderPartition(folder) for folder in self.folders]

    def entries(self, partition: FolderPartition) -> Iterator[tuple]:
        for name in partition.folders:
            filesystem, folder = locate(None, name.rstrip("/"))
            for info in walk(filesystem, folder, self.recursive):
                if self.passes(info):
                    yield _entry(info, name.rstrip("/") + info.path[len(folder):])

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        entries = self.entries(partition)
        while rows := list(islice(entries, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), _MANIFEST_ARROW)], schema=_MANIFEST_ARROW)


class LandingStreamReader(DataSourceStreamReader):
    """Each trigger is one poll of the folders: a micro-batch holds what lies there now.

    Folders are listed in tasks, at most ``POLL_TASKS`` of them; a folder that is not there yet is empty. Offsets only
    number the polls. The job that consumes a batch moves its files away, so a batch that is run again finds what is
    still unprocessed, and nothing depends on file times.
    """

    def __init__(self, folders: list[str], recursive: bool):
        self.folders = folders
        self.reader = LandingReader(folders, recursive)

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[FolderPartition]:
        tasks = min(len(self.folders), POLL_TASKS)
        return [FolderPartition(*self.folders[task::tasks]) for task in range(tasks)]

    def read(self, partition: FolderPartition) -> Iterator[tuple]:
        for folder in partition.folders:
            try:
                yield from self.reader.entries(FolderPartition(folder))
            except FileNotFoundError:
                continue


class LandingWriter(DataSourceWriter):
    """One row, one named file, all of a job's files or none: see `sealroute.sources.commit`.

    No file has its name before every task has succeeded, and a job that fails leaves nothing. A row without content
    is refused: an empty file has empty content. The files of a named ``job`` are only recorded: whoever named it gives
    them their names, as ``save_files`` does."""

    def __init__(self, folder: str, job: str | None = None):
        self.folder = folder.rstrip("/")
        self.named = job is not None
        self.job = job or new_job()

    def write(self, rows: Iterable) -> WriterCommitMessage:
        return stage(self.folder, self.job, (
            (row["path"], None if row["content"] is None else bytes(row["content"])) for row in rows))

    def commit(self, messages: list) -> None:
        if not self.named:
            commit(self.folder, self.job, messages)
        elif any(task.files for task in messages):
            record(self.folder, self.job, messages)

    def abort(self, messages: list) -> None:
        discard(self.folder, self.job)


class LandingSource(DataSource):
    """``spark.read.format("landing")`` over a folder, or several through the option ``folders``."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> StructType:
        return MANIFEST

    def _scan(self) -> tuple[list[str], bool]:
        folders = json.loads(self.options["folders"]) if "folders" in self.options else [self.options["path"]]
        return folders, self.options.get("recursive", "false").lower() == "true"

    def reader(self, schema: StructType) -> LandingReader:
        return LandingReader(*self._scan())

    def streamReader(self, schema: StructType) -> LandingStreamReader:
        return LandingStreamReader(*self._scan())

    def writer(self, schema: StructType, overwrite: bool) -> LandingWriter:
        if overwrite:
            raise ValueError("the landing writer only adds and replaces files; use replace_folder for a full load")
        return LandingWriter(self.options["path"], self.options.get("job"))


def list_folders(
    requests: DataFrame, folder: str, recursive: bool = False, tasks: int | None = None, temporary: bool = False
) -> DataFrame:
    """One row per file in each request's folder, with the request's own columns carried along.

    Every folder is listed inside a task, so no listing passes through the driver. ``root`` is
    the storage root of a request; paths stay relative to it. A root that cannot be opened gives
    one row with ``storage_error``, a folder that cannot be listed one with ``listing_error``, and
    an empty folder none.
    """
    added = [field for field in MANIFEST.fields if field.name != "is_dir"]
    errors = [StructField("listing_error", StringType()), StructField("storage_error", StringType())]
    schema = StructType([*requests.schema.fields, *added, *errors])
    position = requests.columns.index(folder)
    root_position = requests.columns.index("root")

    def listed(values: tuple) -> Iterator[tuple]:
        base = values[position].rstrip("/")
        try:
            filesystem, start = locate(values[root_position], base)
        except (OSError, ValueError) as error:
            yield (*values, None, None, None, None, None, str(error))
            return
        try:
            for info in walk(filesystem, start, recursive, temporary):
                if info.type != pafs.FileType.Directory:
                    yield (*values, *_entry(info, base + info.path[len(start):])[:4], None, None)
        except OSError as error:
            yield (*values, None, None, None, None, str(error), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in target]
            return pa.RecordBatch.from_arrays(
                [pa.array(column, type=field.type) for column, field in zip(columns, target)], schema=target)

        for batch in batches:
            target = pa.schema([*batch.schema, *_ADDED_ARROW])
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                for entry in listed(row):
                    rows.append(entry)
                    if len(rows) >= BATCH_ROWS:
                        yield flush()
                        rows.clear()
        if rows:
            yield flush()

    spread = requests.repartition(tasks or requests.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, schema)


_MANIFEST_ARROW = pa.schema([
    pa.field("path", pa.string()), pa.field("name", pa.string()), pa.field("length", pa.int64()),
    pa.field("modified", pa.timestamp("us", tz="UTC")), pa.field("is_dir", pa.bool_()),
])
_ADDED_ARROW = [
    pa.field("path", pa.string()), pa.field("name", pa.string()), pa.field("length", pa.int64()),
    pa.field("modified", pa.timestamp("us", tz="UTC")), pa.field("listing_error", pa.string()),
    pa.field("storage_error", pa.string()),
]


def read_manifest(spark, folders: list[str], recursive: bool = False) -> DataFrame:
    """Manifest of the files in the given folders; directories are dropped."""
    reader = spark.read.format("landing").option("folders", json.dumps(folders))
    return reader.option("recursive", str(recursive).lower()).load().filter(~F.col("is_dir"))
