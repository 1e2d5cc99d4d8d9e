"""Functions by content: every distinct blob is lexed once, whatever refers to it.

A blob is named by the sha256 of its content.  ``Cache`` keeps what was extracted in
tables on disk, keyed by that name and by the extractor's version: a read extracts only
blobs that no published part has, and publishes them whole as a new part.
"""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.publish import Folder
from lodestone.sources.c_source import extract, in_runs

#: Changes with what ``ranges`` gives; parts of other versions are never read.
VERSION = 1
RANGES = "blob string, ordinal int, name string, start int, end int"
_KEYS = "blob string"


def blob_name(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def ranges(blobs: DataFrame) -> DataFrame:
    """blob, ordinal, name, start, end (lines from 1, inclusive) of the functions of distinct blobs (blob, content), in the order of the text."""

    def own(blob: str, content: str) -> list[dict]:
        rows = sorted((r["line_start"], r["line_end"], r["symbol_name"]) for r in extract("", content) if r["node_type"] == "function")
        return [{"blob": blob, "ordinal": i, "name": name, "start": start, "end": end} for i, (start, end, name) in enumerate(rows)]

    return in_runs(blobs.select("blob", "content"), RANGES, own)


class Cache:
    """Function ranges below a folder, by blob."""

    def __init__(self, spark: SparkSession, root: str, version: int = VERSION):
        self.spark, self.folder, self.version = spark, Folder(spark, root), version

    def _parts(self) -> list[str]:
        """Published parts of this version."""
        return [f"parts/{n}" for n in self.folder.names("parts") if n.startswith(f"v{self.version}-")]

    def known(self) -> DataFrame:
        """blob: what has been extracted, with or without functions."""
        return self.folder.read(self._parts(), "keys", _KEYS).distinct()

    def ranges(self, blobs: DataFrame) -> DataFrame:
        """As ``ranges`` of all ``blobs``; only those that are not known are extracted, and they are known then."""
        fresh = blobs.join(self.known(), "blob", "left_anti").dropDuplicates(["blob"])
        if not fresh.isEmpty():
            self.folder.publish(f"parts/v{self.version}-{uuid.uuid4().hex}", {"keys": fresh.select("blob"), "rows": ranges(fresh)})
        # Two writers may have published the same blob.
        rows = self.folder.read(self._parts(), "rows", RANGES).dropDuplicates(["blob", "ordinal"])
        return rows.join(blobs.select("blob").distinct(), "blob", "left_semi")


def node_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change (new, removed, changed) between node rows (id, code, docstring) of the same files before and after."""
    own = lambda nodes, name: nodes.groupBy("id").agg(F.sort_array(F.collect_set(F.xxhash64("node_type", "code", "docstring"))).alias(name))
    met = own(before, "old").join(own(after, "new"), "id", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return met.select("id", change.alias("change")).where("change IS NOT NULL")
