"""Places that driver and executors share, written tables and plain files in them."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of a batch between the JVM and a Python worker, where the session leaves Spark's own 64 MB: both sides hold several at a time.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; bound the batches that they get."""
    if spark.conf.get(BATCH_BYTES[0]) == "67108864b":
        spark.conf.set(*BATCH_BYTES)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset one is made on a single machine (tests), and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that saved() writes inside, but for those to keep, are removed at the end: results must not read them any more."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        for path in _scopes.paths:
            drop(spark, path)
        _scopes.paths = outer


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage and survives lost executors.

    keep: it stays beyond the scope, if there is one, as what is returned to a caller reads it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    if not keep and getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, key: list[str], total: int, shares: int = 10_000) -> DataFrame:
    """Left join of rows with a table that has one row for each key and, as n_rows, how many of the rows have it.

    total: number of the rows. Fewer than ``shares`` keys can have more than total / shares rows each, so those are sent to all tasks; only
    rows of other keys are dealt by key, and no task gets a large group of them."""
    often = (F.col("n_rows") * shares > total) & (F.col("n_rows") > 1)
    hot, cold = table.where(often).drop("n_rows"), table.where(~often).drop("n_rows")
    first = rows.join(F.broadcast(hot), key)
    return first.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, "left"))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder that no result reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_saved(df: DataFrame) -> None:
    """Remove the files of a table that saved() wrote."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop(df.sparkSession, path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a path without scheme is local."""
    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a whole file under a temporary name and move it into place, so a task that dies or runs twice leaves no half file."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def get(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file, all of it or one range."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length if length is not None else f.size() - offset, offset)




def lean(run: Callable) -> Callable:
    """run, a function over record batches, with what it has freed given back to the system at its end."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return lean_run


def trim() -> None:
    """Give memory that was freed back to the system: workers live on between tasks, and several share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
