"""Sharding by size-tiered compaction (operator 2).

Method: arrivals are appended as small immutable shards; runs of similarly sized
shards are merged into larger ones until they reach the target size; every change
of the set of shards is one new version of a manifest, committed atomically.

A store is a folder: ``data/<run>/*.parquet`` (shards, never changed) and
``manifest/v<number>`` (one row per shard: path, bytes, rows, tier).  A manifest is
written to a folder of its own and published by one rename that doesn't overwrite,
which is atomic on HDFS and local file systems (an object store needs one with
atomic renames on top).  Of two writers of a version one wins; the other reads the
new version and applies its change to that, and gives up a merge whose shards are
gone.  Files that no manifest names (of a failed or lost writer) are never read.

A merge is a map-only job: Spark packs the files of a tier into splits of about
the target size and every split becomes one shard, so nothing is shuffled and a
lost executor costs the tasks it ran.  The driver handles one row per shard.

Defined results: rows are kept as they are, with nulls, repeats and all columns,
whatever their names (ours is called _shard, with more underscores if that is taken);
an empty table is one version without rows; ties in size merge in order of path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import scratch_path

#: A tier holds shards within this factor of size; so many of a tier are merged.
FACTOR, FANIN = 4, 4
#: Times a change is tried while other writers publish.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int

    def tier(self, target: int) -> int:
        """0 for shards of the target size (half of it at least), then one more for each FACTOR below."""
        tier, size = 0, self.bytes
        while size * 2 < target and tier < 20:
            tier, size = tier + 1, size * FACTOR
        return tier


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # -- manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def shards(self, version: int | None = None) -> list[Shard]:
        found = self.versions()
        if not found:
            return []
        rows = self.spark.read.parquet(f"{self.root}/manifest/v{found[-1] if version is None else version}").collect()
        return sorted((Shard(r["path"], r["bytes"], r["rows"]) for r in rows), key=lambda s: s.path)

    def _commit(self, shards: list[Shard], base: int) -> int:
        new = base + 1
        draft = f"{self.root}/drafts/{scratch_path(self.spark, 'm').rsplit('/', 1)[-1]}"
        rows = pa.table({"path": pa.array([s.path for s in shards], pa.string()), "bytes": pa.array([s.bytes for s in shards], pa.int64()), "rows": pa.array([s.rows for s in shards], pa.int64()), "tier": pa.array([s.tier(self.target) for s in shards], pa.int32())})
        self.spark.createDataFrame(rows).coalesce(1).write.parquet(draft)
        jvm = self.spark.sparkContext._jvm
        goal = self._path(f"{self.root}/manifest/v{new}")
        # A rename without overwriting: of two writers of one version the second fails.
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(draft).toUri() if ":" in draft else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), goal, options)
        except Py4JJavaError as e:
            if self._fs.exists(goal):
                raise Conflict(f"version {new} exists") from e
            raise
        return new

    def _last(self) -> int:
        return max(self.versions(), default=0)

    # -- data

    def _written(self, df: DataFrame) -> list[Shard]:
        """Write one run and list its shards; rows are counted from what was written."""
        run = f"{self.root}/data/{scratch_path(self.spark, 'run').rsplit('/', 1)[-1]}"
        df.write.option("compression", "zstd").parquet(run)
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(run))}
        rows = self.spark.read.parquet(run).select(_file().alias("name"))
        counts = rows.groupBy("name").count().collect()  # a row per shard
        return [Shard(f"{run}/{r['name']}", sizes[r["name"]], r["count"]) for r in counts]

    def _publish(self, change: Callable[[list[Shard]], list[Shard] | None]) -> int | None:
        """Commit ``change`` of the last version's shards, again if another writer was first; None if it has nothing to change."""
        for _ in range(TRIES):
            base = self._last()
            new = change(self.shards(base) if base else [])
            if new is None:
                return None
            try:
                return self._commit(new, base)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} times another writer was first")

    def append(self, df: DataFrame) -> int:
        """Every partition of ``df`` becomes a small shard; gives the version."""
        self._columns(df)
        new = self._written(df)
        return self._publish(lambda shards: shards + new)

    def _columns(self, df: DataFrame) -> None:
        """The schema of the store, which an empty version needs; rows of another are refused, as none of their columns may get lost."""
        if not self._fs.exists(self._path(f"{self.root}/schema")):
            df.limit(0).write.mode("overwrite").parquet(f"{self.root}/schema")
        known, own = ({f.name: f.dataType for f in s} for s in (self._schema(), df.schema))
        if known != own:
            differ = sorted(n for n in known.keys() | own.keys() if known.get(n) != own.get(n))
            raise ValueError(f"not the store's columns: {', '.join(differ)}")

    def plan(self, shards: list[Shard]) -> list[Shard]:
        """The shards to merge next: all of the lowest tier that holds FANIN, with what is still smaller."""
        by: dict[int, list[Shard]] = {}
        for s in shards:
            by.setdefault(s.tier(self.target), []).append(s)
        for tier in sorted(by, reverse=True):
            run = [s for t in by if t >= tier > 0 for s in by[t]]
            if len(run) >= FANIN or (len(run) > 1 and sum(s.bytes for s in run) >= self.target):
                return sorted(run, key=lambda s: (s.bytes, s.path))
        return []

    def compact(self) -> int:
        """Merge tiers until none is full; gives the version."""
        while run := self.plan(self.shards()):
            merged = self._merged(run)
            gone = {s.path for s in run}

            def replaced(shards: list[Shard]) -> list[Shard] | None:
                return [s for s in shards if s.path not in gone] + merged if gone <= {s.path for s in shards} else None

            # None: another writer merged some of these; what is there now is planned anew.
            if self._publish(replaced) is not None and len(merged) >= len(run):
                break
        return self._last()

    def _merged(self, run: list[Shard]) -> list[Shard]:
        """A map-only job in which each task reads about ``target`` bytes of files."""
        names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
        before = {n: self.spark.conf.get(n, None) for n in names}
        parts = max(1, round(sum(s.bytes for s in run) / self.target))
        try:
            self.spark.conf.set(names[0], str(max(self.target, 1)))
            self.spark.conf.set(names[1], "0")
            self.spark.conf.set(names[2], "1")
            rows = self.spark.read.schema(self._schema()).parquet(*(s.path for s in run))
            return self._written(rows.coalesce(parts))
        finally:
            for n, value in before.items():
                self.spark.conf.set(n, value) if value is not None else self.spark.conf.unset(n)

    def _schema(self):
        return self.spark.read.parquet(f"{self.root}/schema").schema

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with _shard (its file's name)."""
        paths = [s.path for s in self.shards(version)]
        rows = self.spark.read.schema(self._schema())
        rows = rows.parquet(*paths) if paths else rows.parquet(f"{self.root}/schema")
        name = "_shard"
        while name in {c.lower() for c in rows.columns}:
            name = "_" + name
        return rows.withColumn(name, _file())


def _file() -> Column:
    """The name of the file a row was read from."""
    return F.substring_index(F.input_file_name(), "/", -1)


def shard(docs: DataFrame, target: int = 16 << 20, arrivals: int = 4) -> DataFrame:
    """Append ``docs`` to a new store in ``arrivals`` parts (by a hash of the id), compact it and read it back."""
    spark = docs.sparkSession
    store = Store(spark, scratch_path(spark, "shards"), target)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(part == i))
        store.compact()
    return store.read()
