"""Shared scratch space: written tables cut lineage and outlive executors.

Everything goes below ``spark.checkpoint.dir``, which driver and executors share. Only where that
setting is unset and the master is local (tests, a laptop) a folder below /tmp is used; on a cluster an unset
one is an error. A workspace's folder goes when the session ends, or with the scope that it was made in.

Python workers live on from task to task: `tidy` gives their memory back at the end of each, and a
workspace holds the Arrow batches that go to them to BATCH_BYTES where the session leaves Spark's default.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/gaugeworks-checkpoints"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Workspaces of each open scope, the innermost last.
_SCOPES: list[list[Workspace]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not root and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or LOCAL_DEFAULT).rstrip("/")


class Workspace:
    """A fresh folder of the shared space; tables are written once and read back by path."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        path, fs = self._place(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        if spark.conf.get(BATCH_SETTING) in ("67108864b", "64MB"):
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        if _SCOPES:
            _SCOPES[-1].append(self)

    def _place(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table: later reads don't recompute, whichever executor is lost."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no frame reads any more."""
        for name in names:
            path, fs = self._place(self.path(name))
            fs.delete(path, True)

    def sweep(self) -> None:
        """Have Spark's cleaner delete the shuffles of what is written: it waits for the driver's garbage collection."""
        self.spark._jvm.System.gc()

    def remove(self) -> None:
        path, fs = self._place(self.root)
        fs.delete(path, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Workspaces made inside go at its end: what they lead to must be written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for work in _SCOPES.pop():
            work.remove()


def release() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that releases the worker's memory when its partition ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI and the path in it; a bare path is a local (mounted) one."""
    if "://" not in uri:
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(uri: str):
    """A stream to a file under a name that no other attempt uses."""
    fs, path = filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:  # by default the suffix decides
        yield out
