"""A sink for finished batches: one Arrow file for each task, and a manifest that makes them count.

A task writes its rows to a file of its own name, whatever attempt it is, and reports it when it
is done. The commit lists the reported files in a manifest, put in place by a rename; only what a
manifest lists is read. So a retried or speculative task leaves no second copy, a job that fails
leaves nothing that is read, and every committed write adds its batches to those before. Paths are
those of pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "pairwright_batches"
_LISTED = "manifest-"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: a file, its rows, and the smallest and largest batch in it."""

    file: str
    rows: int
    first: int | None
    last: int | None


@dataclass
class _File(InputPartition):
    file: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    files, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return files, root.rstrip("/")


def manifests(path: str) -> list[dict]:
    """The committed writes below ``path``, in the order of their names."""
    files, root = _opened(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    held = []
    for info in sorted(found, key=lambda i: i.path):
        if info.base_name.startswith(_LISTED):
            with files.open_input_stream(info.path) as source:
                held.append(json.loads(source.read()))
    return held


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, by: str):
        self.path, self.by = path, by

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        name = f"part-{uuid.uuid4().hex}.arrow"
        rows, first, last, sink, out = 0, None, None, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{root}/{name}")
                out = pa.ipc.new_file(sink, batch.schema)
            out.write_batch(batch)
            keys = batch.column(self.by).drop_null().to_pylist()
            rows += batch.num_rows
            first = min([first, *keys] if first is not None else keys, default=None)
            last = max([last, *keys] if last is not None else keys, default=None)
        if out is None:
            return Written("", 0, None, None)
        out.close()
        sink.close()
        return Written(name, rows, first, last)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        held = [vars(m) for m in messages if m is not None and m.file]
        waiting = f"{root}/.{uuid.uuid4().hex}"
        with files.open_output_stream(waiting) as sink:
            sink.write(json.dumps({"files": held, "rows": sum(m["rows"] for m in held)}).encode())
        number = len(manifests(self.path))
        files.move(waiting, f"{root}/{_LISTED}{number:08d}-{uuid.uuid4().hex[:8]}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{root}/{m.file}")


class BatchReader(DataSourceReader):
    def __init__(self, path: str, first: int | None, last: int | None):
        self.path, self.first, self.last = path, first, last

    def partitions(self) -> list[InputPartition]:
        """The files of committed writes that may hold a batch that is asked for."""
        held = [f for m in manifests(self.path) for f in m["files"]]
        asked = lambda f: f["first"] is None or (
            (self.last is None or f["first"] <= self.last) and (self.first is None or f["last"] >= self.first)
        )
        return [_File(f["file"]) for f in held if asked(f)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, root = _opened(self.path)
        with files.open_input_file(f"{root}/{partition.file}") as source:
            held = pa.ipc.open_file(source)
            for i in range(held.num_record_batches):
                yield held.get_batch(i)


class BatchSource(DataSource):
    """Options: ``path``; ``by``, the column of batch numbers; for reading, ``first`` and ``last``, batches whose
    files are opened."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are added to what is there; write to another path to replace them")
        return BatchWriter(self.options["path"], self.options.get("by", "batch_id"))

    def reader(self, schema: StructType) -> BatchReader:
        bound = lambda name: int(self.options[name]) if name in self.options else None
        return BatchReader(self.options["path"], bound("first"), bound("last"))


def write_batches(df: DataFrame, path: str, by: str = "batch_id") -> None:
    """Add the rows of ``df``, each a finished batch or a row of one, to the batches at ``path``."""
    df.sparkSession.dataSource.register(BatchSource)
    df.write.format(FORMAT).options(path=path, by=by).mode("append").save()


def read_batches(
    spark: SparkSession, path: str, schema: str | StructType, by: str = "batch_id", first: int | None = None, last: int | None = None
) -> DataFrame:
    """The batches of all committed writes, or those from ``first`` to ``last``, whose files alone are opened."""
    spark.dataSource.register(BatchSource)
    asked = {k: str(v) for k, v in {"first": first, "last": last}.items() if v is not None}
    rows = spark.read.format(FORMAT).schema(schema).options(path=path, by=by, **asked).load()
    if first is not None:
        rows = rows.where(rows[by] >= first)
    return rows if last is None else rows.where(rows[by] <= last)
