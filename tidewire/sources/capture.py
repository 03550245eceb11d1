"""Captures as DataFrames: ``spark.read.format("capture")`` after :func:`register`, or :func:`read_captures`.

Here one file is read in one task, record by record, so a file may be of any size and many files scale out.
:mod:`.capture_parts` reads one file in many tasks.
"""

from __future__ import annotations

import hashlib
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schemas import RAW
from .capture_format import Notes, read_capture

BATCH = 4096


def _store(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _opened(path: str):
    store, own = _store(path)
    return store.open_input_stream(own)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self._paths = paths

    def partitions(self):
        return [_File(p) for p in self._paths]

    def read(self, partition):
        with _opened(partition.path) as source:
            for r in read_capture(source):
                yield (r.packet_index, r.ts_ns, r.precision, r.interface_id, r.linktype, r.captured_len, r.original_len, r.raw)


class CaptureDataSource(DataSource):
    """Option ``path``: a file, or several with commas between them."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return RAW

    def reader(self, schema):
        paths = [p for p in self.options.get("path", "").split(",") if p]
        if not paths:
            raise ValueError("option path is missing")
        return _Reader(paths)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureDataSource)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files that a path or pattern names; content is null where tasks can open the files and stream them.

    In a store that only Spark can open files are read whole, so none may have more than 2 GiB there.
    """
    listed = spark.read.format("binaryFile").load(path)
    some = listed.select("path").first()
    try:
        _store(some.path if some else "")
    except (pa.ArrowException, OSError):
        return listed.select("path", "content")
    return listed.select("path", F.lit(None).cast("binary").alias("content"))


def _sources(batches: Iterator[pa.RecordBatch]):
    """(path, how to open it) of the files of a task."""
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield name, lambda name=name, content=content: _opened(name) if content is None else io.BytesIO(content)


def _in_batches(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures that a path or pattern names, through Spark's own file listing, with the file's path and SHA-256.

    A file is streamed twice, for the digest and for the records.
    """
    schema = StructType([StructField("path", StringType()), StructField("sha256", StringType()), *RAW.fields])
    kinds = to_arrow_schema(schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, opened in _sources(batches):
            digest = hashlib.sha256()
            with opened() as source:
                while part := source.read(1 << 20):
                    digest.update(part)
            told = digest.hexdigest()
            with opened() as source:
                for r in read_capture(source, Notes()):
                    yield (name, told, r.packet_index, r.ts_ns, r.precision, r.interface_id, r.linktype, r.captured_len, r.original_len, r.raw)

    return _listed(spark, path).mapInArrow(lambda batches: _in_batches(records(batches), kinds), schema)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, note, times): what the reader passed over in each file, by kind, and each note on what was odd."""
    schema = StructType([StructField("path", StringType()), StructField("kind", StringType()), StructField("note", StringType()), StructField("times", LongType())])
    kinds = to_arrow_schema(schema)

    def notes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, opened in _sources(batches):
            own = Notes()
            with opened() as source:
                for _ in read_capture(source, own):
                    pass
            yield from ((name, kind, None, n) for kind, n in sorted(own.counts.items()))
            yield from ((name, "nonfatal", text, 1) for text in own.nonfatal)

    return _listed(spark, path).mapInArrow(lambda batches: _in_batches(notes(batches), kinds), schema)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of whole files. A file is streamed by the task that has it, a block at a time."""
    schema = StructType([StructField("path", StringType()), StructField("sha256", StringType()), StructField("bytes", LongType())])
    kinds = to_arrow_schema(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, opened in _sources(batches):
            digest, n = hashlib.sha256(), 0
            with opened() as source:
                while part := source.read(1 << 20):
                    digest.update(part)
                    n += len(part)
            yield name, digest.hexdigest(), n

    return _listed(spark, path).mapInArrow(lambda batches: _in_batches(digests(batches), kinds), schema)
