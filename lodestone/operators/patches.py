"""Unified diffs, patch application and snapshots."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.session import written
from lodestone.sources.c_source import in_runs

LINE = "struct<line_no:int,text:string>"
HUNK = f"diff_id string, hunk int, file_path string, old_start int, new_start int, before_context array<string>, removed_lines array<{LINE}>, added_lines array<{LINE}>, after_context array<string>"
_HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str, root: str = "") -> Iterator[dict]:
    """Hunks of a unified diff; the counts in a hunk's header say where it ends, so any content is safe."""
    path, lines, at = "", text.split("\n"), 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith("+++ "):
            path = line[4:].split("\t")[0].strip()
            path = path[2:] if path[:2] in ("a/", "b/") else path
            if root and path.startswith(root):
                path = path[len(root) :].lstrip("/")
            continue
        head = _HEADER.match(line)
        if not head:
            continue
        old, new = int(head[1]), int(head[3])
        left, right = int(head[2] or 1), int(head[4] or 1)
        # A side without lines names the line before the change.
        old, new = old + (left == 0), new + (right == 0)
        hunk = {"file_path": path, "old_start": old, "new_start": new, "before_context": [], "removed_lines": [], "added_lines": [], "after_context": []}
        while at < len(lines) and (left > 0 or right > 0):
            kind, body = lines[at][:1], lines[at][1:]
            at += 1
            if kind == "-":
                hunk["removed_lines"].append({"line_no": old, "text": body})
                old, left = old + 1, left - 1
            elif kind == "+":
                hunk["added_lines"].append({"line_no": new, "text": body})
                new, right = new + 1, right - 1
            elif kind != "\\":
                changed = hunk["removed_lines"] or hunk["added_lines"]
                hunk["after_context" if changed else "before_context"].append(body)
                old, new, left, right = old + 1, new + 1, left - 1, right - 1
        yield hunk


def hunks(diffs: DataFrame, root: str = "") -> DataFrame:
    """Hunks of diffs (diff_id, text)."""

    def own(diff: str, text: str) -> list[dict]:
        return [{"diff_id": diff, "hunk": n, **h} for n, h in enumerate(parse_diff(text, root))]

    return in_runs(diffs.select("diff_id", "text"), HUNK, own)


def start_line(df: DataFrame) -> DataFrame:
    """start_line, end_line: of removed lines, else of added ones, else 0."""
    first = F.coalesce(F.get("removed_lines", 0)["line_no"], F.get("added_lines", 0)["line_no"], F.lit(0))
    last = F.coalesce(F.try_element_at("removed_lines", F.lit(-1))["line_no"], F.try_element_at("added_lines", F.lit(-1))["line_no"], F.lit(0))
    return df.withColumn("start_line", first).withColumn("end_line", last)


def apply_hunks(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, line_no, text after all hunks of each path, by the original line numbers.

    Lines and hunks meet by path and line, so files are never gathered: removed lines
    go, every added line comes after the kept line that is before it in its hunk, and
    lines are numbered anew.
    """
    removed = found.select(F.col("file_path").alias("path"), F.explode("removed_lines").alias("x")).select("path", F.col("x.line_no").alias("line_no"), F.col("x.text").alias("old"))
    kept = files.join(removed, ["path", "line_no"], "left_anti").select("path", F.col("line_no").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("nth"), "text")
    added = found.select(F.col("file_path").alias("path"), "old_start", "new_start", "removed_lines", F.posexplode("added_lines").alias("nth", "x"))
    # Lines of the hunk that stay before it, and how many removed ones lie between them.
    stay = F.col("x.line_no") - F.col("new_start") - F.col("nth")
    gone = F.size(F.filter("removed_lines", lambda r, i: r["line_no"] - F.col("old_start") - i < stay))
    added = added.select("path", (F.col("old_start") - 1 + stay + gone).alias("at"), F.lit(2).alias("turn"), F.col("x.line_no").alias("nth"), F.col("x.text").alias("text"))
    order = Window.partitionBy("path").orderBy("at", "turn", "nth")
    return kept.union(added).withColumn("line_no", F.row_number().over(order)).select("path", "line_no", "text")


def conflicts(files: DataFrame, found: DataFrame) -> DataFrame:
    """Removed lines that aren't in the file as the diff has them: what strict application refuses."""
    removed = found.select("diff_id", "hunk", F.col("file_path").alias("path"), F.explode("removed_lines").alias("x")).select("diff_id", "hunk", "path", F.col("x.line_no").alias("line_no"), F.col("x.text").alias("expected"))
    return removed.join(files, ["path", "line_no"], "left").where(~F.col("expected").eqNullSafe(F.col("text")))


def affected_nodes(found: DataFrame, nodes: DataFrame, width: int = 256) -> DataFrame:
    """diff_id, hunk, id: nodes (id, file_path, line_start, line_end) that a hunk's lines overlap."""
    from lodestone.operators.asof import overlaps

    a = start_line(found).select("file_path", "diff_id", "hunk", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    b = nodes.select("file_path", "id", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    return overlaps(a, b, ["file_path"], width).select("a.diff_id", "a.hunk", "b.id").distinct()


#: From a state to those that may follow.
LIFECYCLE = {"proposed": ["accepted", "discarded"], "accepted": ["applied", "discarded"]}


def latest_state(events: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """Each proposal's last state from a log of (id, at, state)."""
    return events.groupBy(key).agg(F.max_by("state", at).alias("state"))


def tree_hash(manifest: DataFrame, by: str = "snapshot_id") -> DataFrame:
    """sha256 of the sorted lines 'path sha256' of each snapshot.

    Lines are streamed in order into the digest, so no snapshot's manifest is ever one row; snapshots are read in parallel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            names, sums = [], []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or own != name:
                    if digest is not None:
                        names.append(name), sums.append(digest.hexdigest())
                    name, digest = own, hashlib.sha256(line.encode())
                else:
                    digest.update(f"\n{line}".encode())
            yield put(names, sums)
        if digest is not None:
            yield put([name], [digest.hexdigest()])

    rows = manifest.select(by, F.concat_ws(" ", "path", "sha256").alias("line"))
    kind = rows.schema[by].dataType

    def put(names: list, sums: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, arrow), pa.array(sums, pa.string())], [by, "tree_hash"])

    arrow = to_arrow_type(kind)
    return rows.repartition(by).sortWithinPartitions(by, "line").mapInArrow(run, f"{by} {kind.simpleString()}, tree_hash string")


def file_at(snapshots: DataFrame, files: DataFrame, snapshot_id: str) -> DataFrame:
    """path, content as of a snapshot: the nearest version up its chain of parents (id, parent_id), however long; files (snapshot_id, path, content)."""
    level = chain = written(snapshots.where(F.col("id") == snapshot_id).select("id", "parent_id", F.lit(0).alias("depth")), "chain")
    depth = 0
    while not level.isEmpty():
        depth += 1
        step = snapshots.join(level.select(F.col("parent_id").alias("id")), "id").select("id", "parent_id", F.lit(depth).alias("depth"))
        level = written(step.join(chain, "id", "left_anti"), "chain")
        chain = chain.union(level)
    met = files.join(chain.select(F.col("id").alias("snapshot_id"), "depth"), "snapshot_id")
    return met.groupBy("path").agg(F.min_by("content", "depth").alias("content"))
