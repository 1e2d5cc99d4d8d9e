"""Three-way branch merge (operator 12).

Method: Merkle descent.  A branch is a version of a base table that stores, as
version stores do, what it doesn't share with the base: for each row its hash
tree and the parent's (row; columns and text; blocks of BLOCK lines), and the
leaves that differ.  A leaf has a stable identifier: 2 * i for line i of the
base, 2 * i + 1 for the gap after it (-1: before the first), and a text, null
where a line is dropped.

``merge`` compares the trees from the top.  Rows lie in BUCKETS buckets by the
hash of their key; a bucket's hash is the sum of its rows' hashes, and where it
is the parent's in both branches no row of it is moved or read further.  In the
other buckets the base's rows meet the two branches' trees and changed leaves in
one join by the row's key; equal rows, columns, texts and blocks are skipped, and
where both branches changed a block their leaves are merged by identifier.  Whole
texts are shuffled once; a broadcast holds at most BUCKETS numbers.

A row's key is its id and a hash of the base row, so the rows of an id that a
third of all rows share (null, say) are spread by what they hold.

Counts: a column, line, gap or added row that one branch changed, or both in the
same way, is one clean change; others are one conflict and the left state stays
(edit-edit, edit-delete, insert-insert).  A dropped row counts alone: edit-delete
if the other branch keeps it with changes (the left state stays), else clean.

Defined results: nulls in text and columns are empty; a text has at least one
line; rows that repeat an id are merged each by itself, equal ones with equal
results; an id that base holds can't be added, and rows without an id add none;
of rows that one branch adds twice under an id the greatest stays; clashing extra
columns of the input aren't read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import gathered
from lodestone.llm.scratch import scratch, tidily

#: Lines of a block, and buckets of rows; the latter bounds the broadcast.
BLOCK, BUCKETS = 32, 4096
#: Bytes of text that are held at a time.
SLICE_BYTES = 8 << 20
#: kept, dropped, added; the row's hash and the parent's; trees as little-endian 64-bit numbers: columns, text, blocks.
VERSION = "id long, twin long, bucket int, doc_id long, state string, cells array<string>, text string, parent_row long, row long, parent_tree binary, tree binary, keys array<int>, texts array<string>"

Leaf = tuple[int, str | None]


class Edit(NamedTuple):
    """What a branch does to a row: new columns and leaves, or a drop; and rows that it adds (id, columns, text)."""

    dropped: bool
    cells: list[str]
    leaves: list[Leaf]
    added: list[tuple[int, list[str], str]]


#: (doc_id, columns, lines) -> Edit; has to depend on these alone.
Editor = Callable[[int | None, list[str], list[str]], Edit]


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _leaves(lines: list[str], start: int, own: dict[int, str | None]) -> bytes:
    """The leaves of a block, told apart by a sign before every line: texts hold no line feed."""
    found = ["+" + t.replace("\n", "\n+") for t in [own.get(-1)] if t is not None] if not start else []
    for i, line in enumerate(lines, start):
        text = own.get(2 * i, line)
        found.append("-" if text is None else "=" + text)
        if (gap := own.get(2 * i + 1)) is not None:
            found.append("+" + gap.replace("\n", "\n+"))
    return "\n".join(found).encode()


def block_of(key: int) -> int:
    return max(key, 0) // (2 * BLOCK)


def tree(cells: list[str], blocks: list[int]) -> np.ndarray:
    """Hashes of columns, text and blocks."""
    hashes = np.array(blocks, "<i8")
    return np.concatenate([np.array([_hash("".join(f"{len(c)}:{c}" for c in cells).encode()), _hash(hashes.tobytes())], "<i8"), hashes])


def parent_blocks(lines: list[str]) -> list[int]:
    return [_hash(("=" + "\n=".join(lines[a : a + BLOCK])).encode()) for a in range(0, len(lines), BLOCK)]


def child_blocks(lines: list[str], parent: list[int], leaves: list[Leaf]) -> list[int]:
    """The parent's hashes but for blocks with changed leaves."""
    own, blocks = dict(leaves), list(parent)
    for b in {block_of(k) for k in own}:
        blocks[b] = _hash(_leaves(lines[b * BLOCK : (b + 1) * BLOCK], b * BLOCK, own))
    return blocks


def _row_hash(own: np.ndarray) -> int:
    return _hash(own[:2].tobytes())


def _keyed(base: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The base with its key (id, twin) and bucket; nulls are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = base.select(F.col("doc_id").cast("long").alias("doc_id"), text("text").alias("text"), F.array(*(text(c) for c in columns)).alias("cells"))
    twin = F.xxhash64(F.col("doc_id").isNull(), "text", "cells")
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), twin.alias("twin"), "doc_id", "cells", "text")
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("id", "twin"), F.lit(BUCKETS)).cast("int"))


def branch(base: DataFrame, edit: Editor, columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The version (VERSION) of ``base`` that ``edit`` makes, a row for each row of base and each that is added."""
    fields = [f.split() for f in VERSION.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}

    def made(row: tuple) -> Iterator[tuple]:
        key, twin, doc_id, cells, text, bucket = row
        lines = text.split("\n")
        own = edit(doc_id, cells, lines)
        blocks = parent_blocks(lines)
        parent = tree(cells, blocks)
        if own.dropped:
            yield key, twin, bucket, doc_id, "dropped", None, None, _row_hash(parent), 0, parent.tobytes(), None, None, None
        else:
            child = tree(own.cells, child_blocks(lines, blocks, own.leaves)) if own.leaves or own.cells != cells else parent
            keys, texts = zip(*own.leaves, strict=True) if own.leaves else ((), ())
            yield key, twin, bucket, doc_id, "kept", own.cells, None, _row_hash(parent), _row_hash(child), parent.tobytes(), child.tobytes(), keys, texts
        for new_id, new_cells, new_text in own.added:
            yield new_id, 0, -1, new_id, "added", new_cells, new_text, 0, 0, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 4, SLICE_BYTES):
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in made(row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return _keyed(base, columns).select("id", "twin", "doc_id", "cells", "text", "bucket").mapInArrow(tidily(run), VERSION)


class Merged(NamedTuple):
    """A merged row; no text: it is absent."""

    cells: list[str] | None
    text: str | None
    n_clean: int = 0
    n_edit_edit: int = 0
    n_edit_delete: int = 0
    n_insert_insert: int = 0


class Side(NamedTuple):
    """A branch's row beside its base."""

    state: str
    cells: list[str] | None
    parent_row: int
    row: int
    parent_tree: bytes
    tree: bytes | None
    keys: list[int] | None
    texts: list[str | None] | None

    def leaves(self) -> dict[int, dict[int, str | None]]:
        """Changed leaves by block."""
        found: dict[int, dict[int, str | None]] = {}
        for k, t in zip(self.keys or (), self.texts or (), strict=True):
            found.setdefault(block_of(k), {})[k] = t
        return found


def patched(text: str, leaves: dict[int, str | None]) -> str:
    """``text`` with these leaves."""
    if not leaves:
        return text
    lines, out, at = text.split("\n"), [], 0
    for k in sorted(leaves):
        i, new = k >> 1, leaves[k]
        stop = i + (k & 1)  # a gap comes after its line
        if stop > at:
            out.extend(lines[at:stop])
        at = max(at, i + 1)
        if new is not None:
            out.append(new)
    out.extend(lines[at:])
    return "\n".join(out)


def merge_row(cells: list[str], text: str, left: Side, right: Side) -> Merged:
    """The descent from a row's hashes to its leaves."""
    changed = [s.state == "kept" and s.row != s.parent_row for s in (left, right)]
    gone = [s.state == "dropped" for s in (left, right)]
    if any(gone):
        if all(gone) or not changed[gone[0]]:
            return Merged(None, None, n_clean=1)
        if gone[0]:
            return Merged(None, None, n_edit_delete=1)
        every = {k: t for own in left.leaves().values() for k, t in own.items()}
        return Merged(left.cells, patched(text, every), n_edit_delete=1)
    if not any(changed):
        return Merged(cells, text)
    clean = edits = drops = inserts = 0
    trees = [np.frombuffer(b, "<i8") for b in (left.parent_tree, left.tree, right.tree)]
    (p, l, r), new = trees, cells
    if not p[0] == l[0] == r[0]:
        new = []
        for b, x, y in zip(cells, left.cells, right.cells, strict=True):
            new.append(y if x == b else x)
            if x != b or y != b:
                if x == b or y == b or x == y:
                    clean += 1
                else:
                    edits += 1
    taken: dict[int, str | None] = {}
    if not p[1] == l[1] == r[1]:
        ours, theirs = left.leaves(), right.leaves()
        for b in np.flatnonzero((p[2:] != l[2:]) | (p[2:] != r[2:])).tolist():
            if l[b + 2] == p[b + 2]:
                taken |= theirs[b]
                clean += len(theirs[b])
            elif r[b + 2] == p[b + 2] or r[b + 2] == l[b + 2]:
                taken |= ours[b]
                clean += len(ours[b])
            else:
                taken |= theirs[b] | ours[b]
                both = ours[b].keys() & theirs[b].keys()
                clean += len(ours[b]) + len(theirs[b]) - 2 * len(both)
                for k in both:
                    x, y = ours[b][k], theirs[b][k]
                    if x == y:
                        clean += 1
                    elif k & 1:
                        inserts += 1
                    elif x is None or y is None:
                        drops += 1
                    else:
                        edits += 1
    return Merged(new, patched(text, taken), clean, edits, drops, inserts)


_COUNTS = ["n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose hash isn't the parent's in both branches; at most BUCKETS rows."""
    own = lambda c: F.sum(F.xxhash64("id", "twin", c).cast("decimal(38,0)"))
    found = [v.where("state <> 'added'").groupBy("bucket").agg(own("parent_row").alias("p"), own("row").alias("h")).where("p <> h").select("bucket") for v in (left, right)]
    return found[0].union(found[1]).distinct()


def merge(base: DataFrame, left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the columns, text (all null: absent) and the counts for every id of the base and of the two versions of it.

    ``left`` and ``right`` are what ``branch`` made of ``base``, written as tables: they are read more than once.
    """
    fields = list(Side._fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2, SLICE_BYTES):
            names, cells, texts, lefts, rights = (c.to_pylist() for c in batch.columns)
            rows = [merge_row(c, t, Side(**x), Side(**y)) for c, t, x, y in zip(cells, texts, lefts, rights, strict=True)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(columns[0], pa.list_(pa.string())), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                names=["doc_id", "cells", "text", *_COUNTS],
            )

    differing, rows = F.broadcast(_differing(left, right)), _keyed(base, columns)
    sides = []
    for v, name in ((left, "l"), (right, "r")):
        own = v.where("state <> 'added'").join(differing, "bucket", "left_semi")
        sides.append(own.groupBy("id", "twin").agg(F.first(F.struct(*fields)).alias(name)))  # of equal rows one
    met = rows.join(differing, "bucket", "left_semi").join(sides[0], ["id", "twin"]).join(sides[1], ["id", "twin"])
    done = met.select("doc_id", "cells", "text", "l", "r").mapInArrow(tidily(run), f"doc_id long, cells array<string>, text string, {', '.join(f'{c} long' for c in _COUNTS)}")
    none = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
    same = rows.join(differing, "bucket", "left_anti").select("doc_id", "cells", "text", *none)
    found = done.union(same).union(_added(rows, left, right))
    return found.select("doc_id", *(F.col("cells")[i].alias(c) for i, c in enumerate(columns)), "text", *_COUNTS)


def _added(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Whole rows that the branches add, by id."""
    own = lambda v, name: v.where("state = 'added'").select("doc_id", F.lit(name).alias("side"), F.struct("text", "cells").alias("row"))
    pick = lambda name: F.max(F.when(F.col("side") == name, F.col("row"))).alias(name)
    both = own(left, "l").union(own(right, "r")).groupBy("doc_id").agg(pick("l"), pick("r")).join(rows.select("doc_id"), "doc_id", "left_anti")
    row, differ = F.coalesce("l", "r"), (F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r"))).cast("long")
    zero = F.lit(0).cast("long")
    return both.select("doc_id", row["cells"].alias("cells"), row["text"].alias("text"), (1 - differ).alias("n_clean"), zero.alias("n_edit_edit"), zero.alias("n_edit_delete"), differ.alias("n_insert_insert"))


def merge_edits(base: DataFrame, left: Editor, right: Editor, columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Both branches of ``base`` made, written, and merged."""
    with scratch(base.sparkSession, "branches") as own:
        versions = [own.keep(branch(base, e, columns), name) for e, name in ((left, "left"), (right, "right"))]
        return merge(base, versions[0], versions[1], columns)
