"""Conversation prefix trie (operator 13).

Method: succinct level-order tries.  Every conversation is a path of turns; a
path's prefix is named by a chained 128-bit hash.  Equal paths are one path with
a count, its smallest conversation and a digest of its conversations.

A prefix through which more than a HEAVY_NODES-th of all turns' paths run is
heavy, so there are at most HEAVY_NODES of them, whatever the input.  Below them
paths are dealt to shards by their first prefix that isn't heavy; a third of all
conversations with one first turn are so spread by their second.  A task builds
its shard's trie in level order with numpy: a LOUDS bitvector (a one for each
child and a zero for each node, in breadth-first order) and label arrays.
Parents and degrees are read from the bitvector by rank; rollups run from the
last level up with add.at and minimum.at.  The heavy upper levels are merged
apart: shards' tops are summed by their parent in Spark, and one trie of the at
most HEAVY_NODES heavy nodes is rolled up the same way.

Conversations are streamed in order once, dealt by the block of a hundred ids
that share a head; what is shuffled is a hash and a length a turn, never a text.
A path is one row of 20 bytes a turn.  The digest of the conversations that end at
a node is sequential by definition; ids are first joined to long pieces where
they are sorted (by ranges of node and id, so that one node may span tasks), and
the digest streams over these.

Defined results: turns are ordered by turn (null first), then role, then the md5
of the text; a null role or text is empty; repeated rows are turns of their own;
rows without a conversation id belong to no conversation and take no part; clashing
extra columns aren't read; an empty table has no conversation and so no node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import runs_of
from lodestone.llm.scratch import Scratch, scratch, tidily

#: Bound on heavy prefixes, and so on what the upper levels' merge and the set sent to the tasks hold.
HEAVY_NODES = 20_000
#: Paths that a prefix may have, at least, before it can be heavy.
LEAST_HEAVY = 2_000
#: Turns of a shard, about; ids joined to one piece of a digest.
SHARD_TURNS, PIECE_IDS = 20_000, 20_000
#: Bytes of a prefix's name; the root's name.
WIDTH = 16
ROOT = bytes(WIDTH)
#: Conversations that share a head.
BLOCK = 100

PATHS = "conv_id long, end binary, keys binary, chars binary"
NODES = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def head_turns(conv_id: int) -> int:
    """Turns that a conversation takes from the first of its block."""
    return zlib.crc32(str(conv_id).encode()) % 6


def paths(turns: DataFrame, head: Callable[[int], int] = head_turns) -> DataFrame:
    """One row a conversation: its rebuilt path's prefixes (``keys``) and their last texts' code points, little-endian."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.md5(text).alias("text"), F.char_length(text).cast("int").alias("chars"))
    rows = rows.withColumn("first", F.col("conv_id") - F.col("conv_id") % BLOCK)
    rows = rows.repartition("first").sortWithinPartitions("first", (F.col("conv_id") != F.col("first")), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv_id", "first", F.unhex(F.md5(F.concat_ws("\n", "role", "text"))).alias("turn"), "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, first, taken = None, [], None, []
        out: list[tuple] = []

        def close() -> None:
            nonlocal taken
            if conv is None:
                return
            if conv == first:
                taken = own[:5]
            h = head(conv)
            whole = own if conv == first else taken[:h] + own[h:]
            key, names = ROOT, []
            for turn, _ in whole:
                key = hashlib.blake2b(key + turn, digest_size=WIDTH).digest()
                names.append(key)
            out.append((conv, key, b"".join(names), np.array([c for _, c in whole], "<i4").tobytes()))

        def put() -> pa.RecordBatch:
            found = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.binary(), pa.binary(), pa.binary()])]
            out.clear()
            return pa.RecordBatch.from_arrays(found, names=["conv_id", "end", "keys", "chars"])

        for batch in batches:
            for c, f, turn, chars in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != conv:
                    close()
                    if f != first:
                        first, taken = f, []
                    conv, own = c, []
                own.append((turn, chars))
            yield put()
        close()
        yield put()

    return rows.mapInArrow(tidily(run), PATHS)


def ends(found: DataFrame) -> DataFrame:
    """For each path's end: its conversations' number, the smallest, and the digest of all their ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            ids, keys = batch.column(1).to_numpy(), batch.column(0)
            coded = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(coded)) + 1, np.arange(0, len(ids), PIECE_IDS), [len(ids)]])).tolist()
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cuts[:-1], pa.int64())), pa.array(ids[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(texts, pa.string())], names=["end", "conv_id", "n", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for end, conv, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != end:
                    if state is not None:
                        done.append(state)
                    state = [end, conv, 0, hashlib.sha256()]
                if state[2]:
                    state[3].update(b",")
                state[2] += n
                state[3].update(ids.encode())
            yield put(done)
        if state is not None:
            yield put([state])

    def put(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3].hexdigest() for d in done], pa.string())], names=["end", "conv_id", "n", "sha"])

    rows = found.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    joined = rows.mapInArrow(tidily(pieces), "end binary, conv_id long, n long, ids string")
    return joined.repartition("end").sortWithinPartitions("end", "conv_id").mapInArrow(tidily(digests), "end binary, conv_id long, n long, sha string")


class Trie:
    """A trie in level order.

    ``louds`` holds, node by node in breadth-first order, a one for each child and
    then a zero; ``labels`` the prefixes.  Node 0 is the top, above all given nodes.
    """

    def __init__(self, keys: np.ndarray, above: np.ndarray, level: np.ndarray):
        """Distinct nodes: their key, the index of the node above (-1: the top) and their level below the top, in any order."""
        size, levels = len(keys), []
        place = np.zeros(size + 1, dtype=np.int64)  # the last is the top's
        by_level, at = np.argsort(level, kind="stable"), 1
        bounds = [*np.flatnonzero(np.diff(level[by_level], prepend=-1)).tolist(), size]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = by_level[a:b]
            own = own[np.lexsort((keys[own], place[above[own]]))]
            place[own] = np.arange(at, at + len(own))
            levels.append((at, at + len(own)))
            at += len(own)
        self.order = np.empty(size, dtype=np.int64)  # breadth-first place (without the top) -> given index
        self.order[place[:-1] - 1] = np.arange(size)
        self.levels, self.labels = levels, keys[self.order]
        degrees = np.bincount(place[above], minlength=size + 1) if size else np.zeros(1, np.int64)
        self.louds = np.ones(2 * size + 1, dtype=bool)
        self.louds[np.cumsum(degrees + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """Of every node but the top: zeros before the node's one are the nodes before its parent."""
        return np.cumsum(~self.louds)[self.louds]

    def degrees(self) -> np.ndarray:
        """Ones before a node's zero, less those before the zero before it."""
        return np.diff(np.flatnonzero(~self.louds), prepend=-1) - 1

    def rollup(self, own: np.ndarray, at: Callable, start: np.ndarray | None = None) -> np.ndarray:
        """``own`` (by breadth-first place) combined over subtrees, from the last level up."""
        total, parents = own.copy() if start is None else start, self.parents()
        for a, b in reversed(self.levels):
            at(total, parents[a - 1 : b - 1], total[a:b])
        return total


_NEVER = np.iinfo(np.int64).max


def rolled(keys: np.ndarray, above: np.ndarray, level: np.ndarray, depth: np.ndarray, chars: np.ndarray, n: np.ndarray, conv: np.ndarray, leaves: np.ndarray, saved: np.ndarray, children: np.ndarray) -> tuple[Trie, dict[str, np.ndarray]]:
    """The trie of these nodes and its rollups, the top first.

    n, conv: conversations that end at a node or come from shards below it; leaves,
    saved, children: what shards below it hold.
    """
    made = Trie(keys, above, level)
    top = lambda x, fill=0: np.concatenate([[fill], x[made.order]]).astype(np.int64)
    n_convs = made.rollup(top(n), np.add.at)
    n_children = made.degrees() + top(children)
    own_saved = np.maximum(n_convs - 1, 0) * top(chars)
    return made, {
        "depth": top(depth),
        "n_convs": n_convs,
        "conv_id": made.rollup(top(conv, _NEVER), np.minimum.at),
        "n_children": n_children,
        "n_leaves": made.rollup(top(leaves) + (n_children == 0), np.add.at),
        "saved_tokens": made.rollup(own_saved + top(saved), np.add.at),
    }


def shard_nodes(found: pa.Table) -> pa.Table:
    """The nodes (NODES) of one shard's paths: ``start`` is the depth of a path's first prefix that isn't heavy; a top's parent_conv_id is left null."""
    found = found.combine_chunks()
    keys = np.frombuffer(b"".join(found["keys"].to_pylist()), f"V{WIDTH}")
    chars = np.frombuffer(b"".join(found["chars"].to_pylist()), "<i4")
    lengths = np.array([len(k) // WIDTH for k in found["keys"].to_pylist()], dtype=np.int64)
    starts = found["start"].to_numpy().astype(np.int64) - 1
    offsets = np.cumsum(lengths) - lengths
    kept = runs_of(offsets + starts, lengths - starts)
    heads = np.cumsum(lengths - starts) - (lengths - starts)
    depth_of = kept - np.repeat(offsets, lengths - starts) + 1
    words = keys[kept].view("<u8").reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
    node = np.empty(len(order), dtype=np.int64)
    node[order] = np.cumsum(new) - 1  # a number by the key's order, so it may stand for the key
    one = order[new]  # an occurrence of each node
    before = np.concatenate([[-1], node[:-1]])  # the node above, for all but a path's first
    before[heads] = -1
    size, last = len(one), np.cumsum(lengths - starts) - 1
    n, conv = np.zeros(size, dtype=np.int64), np.full(size, _NEVER)
    sha = np.full(size, EMPTY_SHA, dtype=object)
    n[node[last]], conv[node[last]], sha[node[last]] = found["n"].to_numpy(), found["conv_id"].to_numpy(), found["sha"].to_pylist()
    none = np.zeros(size, dtype=np.int64)
    level = (depth_of - np.repeat(starts, lengths - starts))[one]
    made, own = rolled(np.arange(size), before[one], level, depth_of[one], chars[kept][one], n, conv, none, none, none)
    parents = made.parents()
    above = np.where(kept[one] > np.repeat(offsets, lengths - starts)[one], kept[one] - 1, -1)[made.order]
    tops = parents == 0
    names = keys[kept][one][made.order].tolist()
    parent = [(keys[a].tobytes() if a >= 0 else ROOT) if t else None for a, t in zip(above.tolist(), tops.tolist(), strict=True)]
    column = lambda k: pa.array(own[k][1:], pa.int64())
    return pa.table(
        {
            "key": pa.array([bytes(k) for k in names], pa.binary()),
            "parent": pa.array(parent, pa.binary()),
            "conv_id": column("conv_id"),
            "depth": column("depth"),
            "parent_conv_id": pa.array(own["conv_id"][parents], pa.int64(), mask=tops),
            "n_convs": column("n_convs"),
            "n_children": column("n_children"),
            "n_leaves": column("n_leaves"),
            "saved_tokens": column("saved_tokens"),
            "ends_sha256": pa.array(sha[made.order].tolist(), pa.string()),
        }
    )


def _heavy(distinct: DataFrame, turns: int, heavy_nodes: int, least: int) -> dict[bytes, tuple[bytes, int, int]]:
    """Heavy prefixes: name -> (parent's name, depth, code points).  More than turns / heavy_nodes paths each, so at most heavy_nodes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[bytes, list] = {}
            for names, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                above = ROOT
                for d, c in enumerate(np.frombuffer(chars, "<i4").tolist()):
                    key = names[d * WIDTH : (d + 1) * WIDTH]
                    rows.setdefault(key, [above, d + 1, c, 0])[3] += 1
                    above = key
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), *(pa.array([r[k] for r in rows.values()], t) for k, t in enumerate([pa.binary(), pa.int64(), pa.int64(), pa.int64()]))], names=["key", "above", "depth", "chars", "n"])

    limit = max(least, -(-turns // heavy_nodes))
    rows = distinct.select("keys", "chars").mapInArrow(tidily(counted), "key binary, above binary, depth long, chars long, n long")
    rows = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("chars").alias("chars")).where(F.col("n") > limit)
    return {bytes(r["key"]): (bytes(r["above"]), r["depth"], r["chars"]) for r in rows.collect()}


def _started(distinct: DataFrame, heavy: dict, shards: int) -> DataFrame:
    """Paths with their ``start`` (null: all prefixes are heavy) and ``shard``."""
    names = frozenset(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, tops = [], []
            for keys in batch.column(batch.schema.get_field_index("keys")).to_pylist():
                at = 0
                while keys[at : at + WIDTH] in names:
                    at += WIDTH
                starts.append(at // WIDTH + 1 if at < len(keys) else None)
                tops.append(zlib.crc32(keys[at : at + WIDTH]) % shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int32()), pa.array(tops, pa.int32())], names=[*batch.schema.names, "start", "shard"])

    return distinct.mapInArrow(tidily(run), "end binary, conv_id long, n long, sha string, keys binary, chars binary, start int, shard int")


def _upper(heavy: dict, tops: list, own_ends: dict) -> list[tuple]:
    """Rows of the root and the heavy nodes, from what shards' tops sum up to (by parent) and the paths that end at them."""
    names = list(heavy)
    index = {k: i for i, k in enumerate(names)} | {ROOT: len(names)}
    sums = np.zeros((5, len(names) + 1), dtype=np.int64)
    sums[1] = _NEVER
    for r in tops:
        i = index[bytes(r["parent"])]
        sums[:, i] = [r["n_convs"], r["conv_id"], r["n_leaves"], r["saved_tokens"], r["n"]]
    sha = [EMPTY_SHA] * (len(names) + 1)
    for end, (conv, n, digest) in own_ends.items():
        i = index[end]
        sums[0, i] += n
        sums[1, i] = min(sums[1, i], conv)
        sha[i] = digest
    if not sums[0].any():
        return []
    # The root is a node below the trie's top, so that it is rolled up as all others.
    above = np.array([index[heavy[k][0]] for k in names] + [-1], dtype=np.int64)
    depth = np.array([heavy[k][1] for k in names] + [0], dtype=np.int64)
    chars = np.array([heavy[k][2] for k in names] + [0], dtype=np.int64)
    rank = np.empty(len(names) + 1, dtype=np.int64)
    rank[sorted(range(len(names) + 1), key=lambda i: names[i] if i < len(names) else ROOT)] = np.arange(len(names) + 1)
    made, own = rolled(rank, above, depth, depth, chars, *sums)
    parents = made.parents()
    keys = [*names, ROOT]
    return [
        (keys[i], None, int(own["conv_id"][p]), int(own["depth"][p]), int(own["conv_id"][parents[p - 1]]) if i < len(names) else None, *(int(own[c][p]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), sha[i])
        for p, i in enumerate(made.order.tolist(), 1)
    ]


def prefix_trie(turns: DataFrame, head: Callable[[int], int] = head_turns, heavy_nodes: int = HEAVY_NODES, least_heavy: int = LEAST_HEAVY, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a node (NODES without the names) of the trie over all rebuilt conversations."""
    spark = turns.sparkSession
    with scratch(spark, "trie") as own:
        found = own.put(paths(turns, head), "paths")
        distinct = _distinct(found, own)
        size = distinct.agg(F.sum(F.length("chars") / 4).cast("long").alias("n")).first()["n"] or 0
        heavy = _heavy(distinct, size, heavy_nodes, least_heavy)
        shards = max(1, -(-size // shard_turns))
        started = own.put(_started(distinct, heavy, shards), "started")
        below = started.where("start IS NOT NULL").select("shard", "keys", "chars", "start", "conv_id", "n", "sha")
        nodes = own.keep(below.groupBy("shard").applyInArrow(shard_nodes, NODES), "nodes")
        at_heavy = started.where("start IS NULL").select("end", "conv_id", "n", "sha")  # distinct paths that end at a heavy node or the root
        tops = nodes.where("parent IS NOT NULL").groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
        rows = _upper(heavy, tops.collect(), {bytes(r["end"]): (r["conv_id"], r["n"], r["sha"]) for r in at_heavy.collect()})
        upper = spark.createDataFrame(rows, NODES)
        above = F.broadcast(upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("above")))  # at most heavy_nodes rows and the root
        all_nodes = nodes.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return all_nodes.select(columns).union(upper.select(columns))


def _distinct(found: DataFrame, own: Scratch) -> DataFrame:
    """end, conv_id, n, sha, keys, chars of the distinct paths; the smallest conversation's row stands for all."""
    ended = own.put(ends(found), "ends")
    return own.put(ended.join(found.select("conv_id", "keys", "chars"), "conv_id").select("end", "conv_id", "n", "sha", "keys", "chars"), "distinct")
