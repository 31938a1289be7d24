"""Intermediate tables in the folder shared by driver and executors.

Several plans read one intermediate result more than once (the numbered dictionary, the
encoded words). Such a result is written once as Parquet and read back: the lineage ends
there, readers still prune columns, and a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: list[str] = []


@cache
def _private_root() -> str:
    root = tempfile.mkdtemp(prefix="pairwright-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is made only in local mode without it."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    return _private_root()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/pairwright/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose writing was committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    held = [entry.getPath() for entry in files.listStatus(folder) if entry.isDirectory()]
    mark = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
    return sorted(p.getName() for p in held if files.exists(mark(p)))


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the intermediate tables this process has written but for the first ``keep``; returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    count = max(len(_written) - keep, 0)
    for _ in range(count):
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete what is written inside: for a plan whose results are all stored elsewhere at its end."""
    held = len(_written)
    try:
        yield
    finally:
        release(spark, held)
