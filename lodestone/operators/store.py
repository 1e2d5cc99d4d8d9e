"""Graphs, reports and training rows on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph, lookup
from lodestone.publish import Folder, retried
from lodestone.session import written


class Store:
    """A graph of nodes and edges below a folder.

    Every save is a new version, numbered, and published whole by a rename that only one
    writer of a number can make; readers of an older one aren't disturbed.  A store
    without a version is empty.  A version says what form its tables have: older ones are
    read (columns that they lack are null), newer ones are refused.
    """

    #: The form of the tables that this code writes.
    SCHEMA_VERSION = 2

    def __init__(self, spark: SparkSession, root: str, node_schema: str, edge_schema: str = "src string, dst string, edge_type string"):
        self.spark, self.schemas, self.folder = spark, {"nodes": node_schema, "edges": edge_schema}, Folder(spark, root)

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(n[1:]) for n in self.folder.names() if n.startswith("v") and n[1:].isdigit())

    def _read(self, name: str, version: int | None = None) -> DataFrame:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schemas[name])
        if (form := self.schema_version(version)) > self.SCHEMA_VERSION:
            raise ValueError(f"version {version} has the form {form}, newer than {self.SCHEMA_VERSION}")
        return self.folder.read([f"v{version:08d}"], name, self.schemas[name])

    def schema_version(self, version: int | None = None) -> int:
        """The form that a version, or the newest one, says that it has: 1 if it says nothing or no number, the current one for an empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return self.SCHEMA_VERSION
        if not self.folder.exists(f"v{version:08d}/meta"):
            return 1
        said = self.spark.read.parquet(f"{self.folder.root}/v{version:08d}/meta").first()  # one row
        try:
            return int(said["schema_version"])
        except (TypeError, ValueError):
            return 1

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._read("edges")

    def save(self, nodes: DataFrame, edges: DataFrame, layer: int | None = None, base: int | None = None) -> int:
        """Write a version: all rows, or a layer's nodes and the edges inside it; gives its number.

        ``base``: the version that the rows were made from; publish.Taken if there is a newer one.
        Without it the rows become the next version whatever is there.
        """
        if layer is not None:
            nodes, edges = graph.saved(nodes, edges, layer)
        meta = self.spark.createDataFrame([(self.SCHEMA_VERSION,)], "schema_version int").coalesce(1)

        def publish() -> int:
            number = (max(self.versions(), default=0) if base is None else base) + 1
            self.folder.publish(f"v{number:08d}", {"nodes": nodes, "edges": edges, "meta": meta})
            return number

        return publish() if base is not None else retried(publish)

    def add(self, nodes: DataFrame, order: str | None = None) -> int:
        """Upsert nodes and keep the edges; of one id the last by ``order`` wins, or the last row.

        Made again from the newest version if another writer was first, so no update is lost.
        """
        last = F.monotonically_increasing_id() if order is None else F.col(order)
        fresh = written(graph.upsert(nodes.limit(0), nodes.withColumn("_last", last), F.col("_last")).drop("_last") if order is None else nodes, "fresh")

        def change() -> int:
            base = max(self.versions(), default=0)
            merged = graph.upsert(self._read("nodes", base), fresh, F.col(order) if order else F.lit(0))
            return self.save(merged, self._read("edges", base), base=base)

        return retried(change)

    def get(self, ids: DataFrame) -> DataFrame:
        return lookup.by_ids(self.nodes, ids)

    def find(self, names: DataFrame) -> DataFrame:
        return lookup.by_symbol(self.nodes, names)

    def stats(self) -> DataFrame:
        """metric, key, n: counts of the newest version, and its schema_version."""
        form = self.spark.range(1).select(F.lit("schema_version").alias("metric"), F.lit("").alias("key"), F.lit(self.schema_version()).cast("long").alias("n"))
        return graph.node_stats(self.nodes, self.edges).unionByName(form)


def write_triplets(rows: DataFrame, path: str) -> None:
    """Training rows as JSON lines, nulls left out."""
    rows.write.option("ignoreNullFields", "true").json(path)


def write_report(summary: DataFrame, per_query: DataFrame, path: str) -> None:
    """An evaluation's means and rows as JSON lines, side by side."""
    summary.write.json(f"{path}/summary")
    per_query.write.json(f"{path}/queries")
