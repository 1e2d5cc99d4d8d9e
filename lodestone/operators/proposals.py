"""Proposals: their states, the pending stack, previews, snapshots, application and reverting.

Events are a log of (id, at, state); hunks carry ``diff_id``, the proposal's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import patches
from lodestone.operators.extraction import node_diff
from lodestone.operators.ranking import numbered
from lodestone.sources import c_source


def checked(events: DataFrame) -> DataFrame:
    """Events with ``before`` (the state they follow) and ``valid``: a first one proposes, later ones follow the life cycle."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("at"))
    allowed = F.create_map(*(x for name, to in patches.LIFECYCLE.items() for x in (F.lit(name), F.array(*map(F.lit, to)))))
    rows = events.withColumn("before", before)
    valid = F.when(F.col("before").isNull(), F.col("state") == "proposed").otherwise(F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("state")), F.lit(False)))
    return rows.withColumn("valid", valid)


def in_state(events: DataFrame, state: str) -> DataFrame:
    return patches.latest_state(events).where(F.col("state") == state)


def pending(pushes: DataFrame) -> DataFrame:
    """id, position: the stack of pushes (at, id; a null id clears it), each id once, at its first push since the last clear."""
    cleared = pushes.where("id IS NULL").agg(F.max("at").alias("cleared"))
    live = pushes.where("id IS NOT NULL").where(F.col("at") > F.coalesce(cleared.scalar(), F.lit(-1)))
    first = live.groupBy("id").agg(F.min("at").alias("at"))
    return numbered(first, ["at", "id"]).select("id", (F.col("position") + 1).cast("int").alias("position"))


def changed_files(hunks: DataFrame) -> DataFrame:
    """diff_id, file_path: each file of each proposal once."""
    return hunks.select("diff_id", "file_path").distinct()


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256 of files (path, content)."""
    return files.select("path", digest(F.col("content")).alias("sha256"))


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def as_lines(files: DataFrame) -> DataFrame:
    """path, line_no, text of files (path, content); a file that ends in a line feed has no empty line behind it."""
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    return files.select("path", F.posexplode(lines).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def as_files(lines: DataFrame) -> DataFrame:
    """path, content, each line ended by a line feed."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("path").agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n"), F.lit("\n")).alias("content"))


def preview(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """path, content of the changed files as they would be; nothing is written."""
    touched = files.join(hunks.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")
    return as_files(patches.apply_hunks(as_lines(touched), hunks))


def preview_nodes(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """id, change (new, removed, changed): what the hunks would do to the nodes of the files that they touch; only those are parsed."""
    touched = files.join(hunks.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi").select("path", "content")
    return node_diff(c_source.bodies(touched), c_source.bodies(preview(files, hunks)))


def dry_run(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """diff_id, file_path, removed, added, conflicts (removed lines that the file doesn't have)."""
    sizes = hunks.groupBy("diff_id", "file_path").agg(F.sum(F.size("removed_lines")).alias("removed"), F.sum(F.size("added_lines")).alias("added"))
    wrong = patches.conflicts(as_lines(files), hunks).groupBy("diff_id", F.col("path").alias("file_path")).agg(F.count("*").alias("conflicts"))
    return sizes.join(wrong, ["diff_id", "file_path"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


class Conflict(ValueError):
    """A hunk removes lines that the file doesn't have."""


def applied(files: DataFrame, hunks: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all files after the hunks, the snapshot of the changed ones before: path, content, sha256).

    Strict application refuses hunks whose removed lines the files don't have.
    """
    if strict and not (wrong := patches.conflicts(as_lines(files), hunks)).isEmpty():
        first = wrong.orderBy("diff_id", "path", "line_no").first()
        raise Conflict(f"{first['diff_id']}: {first['path']}:{first['line_no']}")
    touched = hunks.select(F.col("file_path").alias("path")).distinct()
    before = files.join(touched, "path", "left_semi").select("path", "content", digest(F.col("content")).alias("sha256"))
    return files.join(touched, "path", "left_anti").select("path", "content").unionByName(preview(files, hunks)), before


def reverted(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files as a snapshot (path, content) has them; other files stay."""
    return files.join(snapshot.select("path"), "path", "left_anti").select("path", "content").unionByName(snapshot.select("path", "content"))


def history(snapshots: DataFrame, latest: int | None = None) -> DataFrame:
    """Snapshots (id, at, ...), newest first; ``latest``: so many."""
    rows = snapshots.orderBy(F.desc("at"), "id")
    return rows if latest is None else rows.limit(latest)


def to_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("row")).select("row.*")
