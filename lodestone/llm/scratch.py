"""Shared-folder scratch tables: the way this subpackage cuts lineage.

Executors can be lost at any time, so intermediate results that are read more
than once are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and read back.  Nothing is kept in executor-local
storage.  Where the setting is missing a folder of our own is made, on a local
master only; on a cluster that is refused.

``scratch(spark)`` opens a folder for one operator's intermediate tables; those
are deleted when the block ends, apart from what it is told to keep: tables that
the returned DataFrame still reads.  They go when the process ends.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: The folder of our own, where none is set; the setting can't be changed in a running session.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    found = spark.conf.get(_SETTING, None)
    if not found and _own:
        return _own[0]
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_SETTING} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        _own.append(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (below ``at`` if given) and return the table read back.

    An empty frame keeps its schema.  The table is safe against lost executors:
    Spark's commit protocol publishes whole files only.
    """
    spark = df.sparkSession
    path = f"{at}/{name}-{uuid.uuid4().hex}" if at else scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the Hadoop file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_end(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be gone; the folder is the cluster's to clean then
        remove(spark, path)


class Scratch:
    """The intermediate tables of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)
        self.kept = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """A table that goes with the block."""
        return materialise(df, name, f"{self.root}/tables")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that the operator's result reads; it goes when the process ends."""
        if not self.kept:
            atexit.register(_at_end, self.spark, f"{self.root}/kept")
        self.kept += 1
        return materialise(df, name, f"{self.root}/kept")


@contextmanager
def scratch(spark: SparkSession, name: str, rows: int = 2000) -> Iterator[Scratch]:
    """A folder of intermediate tables; Arrow batches have at most ``rows`` rows inside the block, which bounds Python workers."""
    own = Scratch(spark, name)
    with small_batches(spark, rows):
        try:
            yield own
        finally:
            _at_end(spark, f"{own.root}/tables")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table.  The path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows, for plans that run inside the block; bounds the memory of Python workers."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def tidy() -> None:
    """Give freed memory back to the system, so that a reused Python worker keeps nothing of its last task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidily(run: Callable) -> Callable:
    """A function of batches that ends with ``tidy``."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            del batches
            tidy()

    return tidied
