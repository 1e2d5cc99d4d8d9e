"""Exact inner-product top-k (operator 5).

Method: vectors are processed by descending length.  All vectors are rotated by
the right singular vectors of the table, so that the leading coordinates hold
most of every product; a pair is dropped once the partial product of the leading
coordinates plus the product of the residual lengths (Cauchy-Schwarz) can't
reach the query's k-th best score so far.  What is left is multiplied exactly.

Candidates are range-partitioned by length and cut into blocks; a few blocks make
a shard.  Query blocks go to every shard by an equi-join on the shard, and meet
its blocks longest first, so a query's bound tightens from block to block.  The
first bounds come from the HEAD longest vectors, a fixed number.  A third of all
rows being one vector changes nothing: blocks are cut by number of rows.

Scores are integers: with |component| * 256 below 2 ** 20 all products are exact
in doubles; larger ones are multiplied as Python integers and saturate at the
ends of a long.

Other defined results are those of ``vectors``; fewer candidates than k give all
of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, scratch, tidily
from lodestone.llm.vectors import best, blob, clean, gram, matrix, width

#: Vectors of a candidate block, candidate blocks of a shard, vectors of a query block.
BLOCK, SHARD_BLOCKS, QUERY_BLOCK = 2048, 4, 512
#: Longest vectors from which every query takes its first bound.
HEAD = 2048
#: Rotated coordinates of the partial product.
LEADING = 16
_LONG = (1 << 63) - 1


def scaled(m: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * m)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows with rows."""
    top = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    if top * top * max(1, q.shape[1]) < 2**53:
        return (q @ c.T).astype(np.int64)
    ints = [[[int(x) for x in row] for row in m] for m in (q, c)]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(a, b, strict=True)))) for b in ints[1]] for a in ints[0]], dtype=np.int64).reshape(len(q), len(c))


def exact_topk(rows: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows.

    Queries are the rows whose id is divisible by ``every``.
    """
    with scratch(rows.sparkSession, "topk", 10_000) as own:
        return own.keep(_search(rows, own, k, every, scale, id_col, vec_col), "found")


def _search(rows: DataFrame, own: Scratch, k: int, every: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score long"
    vectors = own.put(clean(rows, id_col, vec_col), "vectors")
    d = width(vectors)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    values, basis = np.linalg.eigh(gram(vectors, d, lambda m: scaled(m, scale)))
    lead = min(LEADING, d)
    turn = spark.sparkContext.broadcast(np.ascontiguousarray(basis[:, np.argsort(-values)[:lead]]))

    length = F.sqrt(F.aggregate(F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    n = vectors.count()
    blocks = -(-n // BLOCK)
    shards = max(1, -(-blocks // SHARD_BLOCKS))
    ordered = vectors.withColumn("length", length).repartitionByRange(shards, F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                own = batch.slice(start, BLOCK)
                m = scaled(matrix(own.column(1), d), scale)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), pa.array([blob(own.column(0).to_numpy())], pa.binary()), pa.array([blob(m)], pa.binary())], ["shard", "block", "ids", "m"])
                nth += 1

    candidates = ordered.select("vec_id", "v").mapInArrow(tidily(to_blocks), "shard int, block int, ids binary, m binary")
    # HEAD rows at most come to the driver.
    top = vectors.withColumn("length", length).orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "v").toArrow()
    head = spark.sparkContext.broadcast((top.column("vec_id").to_numpy(), scaled(matrix(top.column("v").combine_chunks(), d), scale)))

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        ids_h, m_h = head.value
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                own = batch.slice(start, QUERY_BLOCK)
                ids, m = own.column(0).to_numpy(), scaled(matrix(own.column(1), d), scale)
                first = products(m, m_h)
                first[ids[:, None] == ids_h[None, :]] = -_LONG - 1
                floor = np.partition(first, len(ids_h) - k, axis=1)[:, len(ids_h) - k] if len(ids_h) > k else np.full(len(ids), -_LONG - 1)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + nth]), pa.array([blob(ids)], pa.binary()), pa.array([blob(m)], pa.binary()), pa.array([blob(floor)], pa.binary())], ["q_block", "q_ids", "q", "floor"])
                nth += 1

    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(to_queries, "q_block long, q_ids binary, q binary, floor binary")
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "*")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        basis = turn.value
        for batch in batches:
            for i in range(batch.num_rows):
                q_block, q_ids, q, floor, ids, m = (batch.column(c)[i].as_py() for c in range(6))
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, m = np.frombuffer(q).reshape(-1, d), np.frombuffer(m).reshape(-1, d)
                if floors.keys() != {q_block}:
                    floors = {q_block: np.frombuffer(floor, np.int64).copy()}
                floor = floors[q_block]
                yield from one(q_ids, q, floor, ids, m, basis)

    def one(q_ids, q, floor, ids, m, basis) -> Iterator[pa.RecordBatch]:
        q_size, m_size = np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1))
        give = 1e-9 * (1 + q_size * m_size.max(initial=0))  # what rounding may take from a bound
        alive = np.flatnonzero(q_size * m_size.max(initial=0) + give >= floor)
        if not len(alive):
            return
        q_lead, m_lead = q[alive] @ basis, m @ basis
        q_rest = np.sqrt(np.maximum(0, q_size[alive] ** 2 - (q_lead**2).sum(1)))
        m_rest = np.sqrt(np.maximum(0, m_size**2 - (m_lead**2).sum(1)))
        hope = q_lead @ m_lead.T + q_rest[:, None] * m_rest[None, :] + give[alive, None] >= floor[alive, None]
        keep = np.flatnonzero(hope.any(axis=0))
        if not len(keep):
            return
        scores = products(q[alive], m[keep])
        out: list[tuple] = []
        for row, a in enumerate(alive.tolist()):
            fit = np.flatnonzero(hope[row, keep] & (scores[row] >= floor[a]) & (ids[keep] != q_ids[a]))
            if len(fit):
                own = fit[best(scores[row, fit], ids[keep][fit], k)]
                if len(own) == k:
                    floor[a] = max(floor[a], int(scores[row, own[-1]]))
                out.append((np.full(len(own), q_ids[a]), ids[keep][own], scores[row, own]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    left = queries.repartition(shards, "shard").sortWithinPartitions("shard", "q_block")
    right = candidates.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    pairs = left.join(right.hint("merge"), "shard").select("q_block", "q_ids", "q", "floor", "ids", "m")
    found = pairs.mapInArrow(tidily(search), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
