"""Training rows mined from a repository's history: commits, diffs and blobs.

Hunks meet the functions of their revision by content: a (blob, line) is looked up
once, however many commits share it, and blobs are lexed once each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import subject_subsystem
from lodestone.operators import traindata
from lodestone.operators.asof import range_first
from lodestone.operators.extraction import Cache, blob_name, ranges
from lodestone.sources.texts import commits, hunk_starts


def blobs_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sha, file, blob) and distinct (blob, content) of files of revisions (sha, file, content)."""
    named = files.select("sha", "file", blob_name(F.coalesce("content", F.lit(""))).alias("blob"), "content")
    return named.select("sha", "file", "blob"), named.groupBy("blob").agg(F.first("content").alias("content"))


def touched(diffs: DataFrame, tree: DataFrame, blobs: DataFrame, cache: Cache | None = None, width: int = 256) -> DataFrame:
    """sha, file, name: the functions that the hunks of diffs (sha, file, text) begin in.

    ``tree``: sha, file, blob (the revision's file); ``blobs``: blob, content.  Only blobs with hunks are lexed.
    """
    starts = hunk_starts(diffs).select("sha", "file", "line").distinct().join(tree.select("sha", "file", "blob"), ["sha", "file"])
    points = starts.select("blob", "line").distinct()
    wanted = blobs.join(points.select("blob").distinct(), "blob", "left_semi")
    functions = cache.ranges(wanted) if cache is not None else ranges(wanted.dropDuplicates(["blob"]))
    met = range_first(points, functions.select("blob", "start", "end", "ordinal", "name"), "line", ["blob"], "ordinal", width)
    return starts.join(met.select("blob", "line", F.col("match.name").alias("name")), ["blob", "line"]).select("sha", "file", "name").distinct()


def mined(log: DataFrame, diffs: DataFrame, tree: DataFrame, blobs: DataFrame, since: str | None = None, cache: Cache | None = None) -> DataFrame:
    """query, commit, date, positives (file::function), subsystem, changed_files of the commits that are fit for training.

    ``log``: blocks of a commit log (``texts.commits``); the rest as in ``touched``.
    """
    known = commits(log, since)
    found = touched(diffs.join(known.select("sha"), "sha", "left_semi"), tree, blobs, cache)
    ids = found.groupBy("sha").agg(F.array_sort(F.collect_set(F.concat_ws("::", "file", "name"))).alias("positives"))
    rows = traindata.useful_commits(known.join(ids, "sha"))
    return rows.select(F.col("subject").alias("query"), F.col("sha").alias("commit"), "date", "positives", subject_subsystem(F.col("subject")).alias("subsystem"), F.col("files").alias("changed_files"))
