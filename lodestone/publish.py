"""Publishing a written folder under a name that only one writer can take."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Times a change is tried while other writers publish.
TRIES = 20


class Taken(RuntimeError):
    """Another writer has published that name."""


class Folder:
    """A folder of published subfolders; drafts lie beside them and are never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, at: str = "") -> list[str]:
        """The names below ``at``, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(at))) if self.exists(at) else []

    def publish(self, name: str, tables: dict[str, DataFrame]) -> None:
        """Write ``tables`` to a draft and rename it to ``name``: all of them are there or none; Taken if the name is."""
        draft = f"drafts/{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{draft}/{table}")
        self._fs.mkdirs(self.path(name).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        # A rename without overwriting: of two writers of one name the second fails.
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(draft), self.path(name), options)
        except Py4JJavaError as e:
            self._fs.delete(self.path(draft), True)
            if self.exists(name):
                raise Taken(name) from e
            raise

    def read(self, names: list[str], table: str, schema: str) -> DataFrame:
        """A table of several published names as one; empty without names."""
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}/{table}" for n in names)) if names else self.spark.createDataFrame([], schema)


def retried(change: Callable[[], object]) -> object:
    """``change`` again while other writers are first."""
    for _ in range(TRIES):
        try:
            return change()
        except Taken:
            continue
    raise Taken(f"{TRIES} times another writer was first")
