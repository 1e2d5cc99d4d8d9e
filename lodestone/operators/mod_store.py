"""Proposals and snapshots as tables on disk.

Contents are stored once, by their sha256.  A snapshot holds the paths that it saved and
their contents' names, and its parent; what it doesn't hold is its nearest ancestor's
(copy-on-write).  Snapshots are numbered, and a number is published by one writer only;
another that wanted it takes the newest as its parent and tries again.  Proposals'
hunks, states and pushes are a log that is only added to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import patches, proposals
from lodestone.publish import Folder, Taken, retried
from lodestone.session import written

META = "id int, parent_id int, at long, description string"
ENTRIES = "snapshot_id int, path string, sha256 string"
BLOBS = "sha256 string, content string"
EVENTS = "id string, at long, state string"
PUSHES = "at long, id string"


class ModStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    # -- a log that is added to

    def _append(self, kind: str, rows: DataFrame) -> None:
        self.folder.publish(f"{kind}/{uuid.uuid4().hex}", {"rows": rows})

    def _all(self, kind: str, schema: str) -> DataFrame:
        return self.folder.read([f"{kind}/{n}" for n in self.folder.names(kind)], "rows", schema)

    def propose(self, hunks: DataFrame, at: int) -> None:
        """Keep hunks (``patches.HUNK``) and put their proposals in the state proposed."""
        hunks = written(hunks, "hunks")
        self._append("hunks", hunks)
        self._append("events", hunks.select(F.col("diff_id").alias("id"), F.lit(at).cast("long").alias("at"), F.lit("proposed").alias("state")).distinct())

    def hunks(self) -> DataFrame:
        return self._all("hunks", patches.HUNK)

    def put_state(self, ids: DataFrame, state: str, at: int) -> None:
        """Move proposals (id) on; ValueError if the life cycle doesn't allow one of them.  Accepted ones go on the pending stack."""
        rows = written(ids.select("id").distinct().withColumn("at", F.lit(at).cast("long")).withColumn("state", F.lit(state)), "events")
        last = patches.latest_state(self.events()).select("id", F.col("state").alias("before"))
        follow = [name for name, to in patches.LIFECYCLE.items() if state in to]
        wrong = rows.join(last, "id", "left").where(~F.coalesce(F.col("before").isin(follow), F.lit(False)))
        if (first := wrong.orderBy("id").first()) is not None:
            raise ValueError(f"{first['id']}: {state} after {first['before']}")
        self._append("events", rows.select("id", "at", "state"))
        if state == "accepted":
            self._append("pushes", rows.select("at", "id"))

    def events(self) -> DataFrame:
        return self._all("events", EVENTS)

    def proposals(self, state: str | None = None) -> DataFrame:
        """id, state of all proposals, or of those in one state."""
        rows = patches.latest_state(self.events())
        return rows if state is None else rows.where(F.col("state") == state)

    def pending(self) -> DataFrame:
        """id, position: accepted and not yet applied, in the order in which they were accepted."""
        return proposals.pending(self._all("pushes", PUSHES)).join(self.proposals("accepted").select("id"), "id", "left_semi")

    # -- snapshots

    def snapshot_ids(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.folder.names("snapshots") if n.startswith("s") and n[1:].isdigit())

    def _names(self) -> list[str]:
        return [f"snapshots/s{n:08d}" for n in self.snapshot_ids()]

    def save_snapshot(self, files: DataFrame, description: str, at: int, parent: int | None = None) -> int:
        """Keep files (path, content) as the next snapshot; its parent is ``parent``, or the newest one."""
        rows = written(files.select("path", "content", proposals.digest(F.col("content")).alias("sha256")), "snapshot")
        known = self._all("blobs", BLOBS).select("sha256")
        self._append("blobs", rows.select("sha256", "content").dropDuplicates(["sha256"]).join(known, "sha256", "left_anti"))

        def publish() -> int:
            newest = max(self.snapshot_ids(), default=0)
            number = newest + 1
            meta = self.spark.createDataFrame([(number, parent if parent is not None else newest or None, at, description)], META).coalesce(1)
            self.folder.publish(f"snapshots/s{number:08d}", {"meta": meta, "entries": rows.select(F.lit(number).alias("snapshot_id"), "path", "sha256")})
            return number

        return retried(publish)

    def snapshots(self) -> DataFrame:
        """id, parent_id, at, description."""
        return self.folder.read(self._names(), "meta", META)

    def history(self, latest: int | None = None) -> DataFrame:
        return proposals.history(self.snapshots(), latest)

    def manifest(self, snapshot: int) -> DataFrame:
        """path, sha256 as of a snapshot: each path's nearest entry up the chain of parents."""
        if snapshot not in self.snapshot_ids():
            raise LookupError(f"no snapshot {snapshot}")
        entries = self.folder.read(self._names(), "entries", ENTRIES)
        return patches.file_at(self.snapshots().select("id", "parent_id"), entries.select("snapshot_id", "path", F.col("sha256").alias("content")), snapshot).select("path", F.col("content").alias("sha256"))

    def files(self, snapshot: int) -> DataFrame:
        """path, content as of a snapshot."""
        contents = self._all("blobs", BLOBS).dropDuplicates(["sha256"])  # two writers may have kept the same
        return self.manifest(snapshot).join(contents, "sha256").select("path", "content")

    # -- work on files

    def apply(self, files: DataFrame, at: int) -> tuple[DataFrame, int | None]:
        """(files after all pending proposals, the snapshot of what they change); proposals become applied, the stack is cleared.

        Nothing pending: the files and None.  ``proposals.Conflict`` if a hunk doesn't fit; nothing is changed then.
        """
        pending = written(self.pending().select("id"), "pending")
        if pending.isEmpty():
            return files, None
        hunks = written(self.hunks().join(pending.select(F.col("id").alias("diff_id")), "diff_id", "left_semi"), "hunks")
        after, before = proposals.applied(files, hunks)
        after = written(after, "applied")
        number = self.save_snapshot(before.select("path", "content"), f"Before applying {pending.count()} proposal(s)", at)
        self.put_state(pending, "applied", at)
        self._append("pushes", self.spark.createDataFrame([(at, None)], PUSHES))
        return after, number

    def revert(self, files: DataFrame, snapshot: int) -> DataFrame:
        """Files as the snapshot's chain has them; files that it never held stay."""
        return proposals.reverted(files, self.files(snapshot))


__all__ = ["ModStore", "Taken"]
