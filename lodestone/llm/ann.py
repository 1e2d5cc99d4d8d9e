"""Approximate nearest neighbours by inner product (operator 10).

Method: balanced posting lists.  Centroids are trained on a bounded sample (rows
chosen by a hash of the id; it grows with the number of lists up to MOST_TRAIN);
every vector goes to its nearest centroid's list and, near a boundary, to those of
up to REPLICAS centroids whose distance is within SPREAD of the nearest.  Centroids
are held in memory with a neighbour graph, and every look-up, of vectors and of
queries, is a beam search on that graph, at any size.  A query reads the lists
whose distance is within a ratio of its nearest list's, and at least so many that
k others are among them.  That ratio is fitted: for sample queries, PROBES of the
queries' rows and PROBES of their different vectors, so that neither copies nor rows
that never ask outvote the rest, the true neighbours are found among all rows, and
the smallest ratio is taken that reaches the recall asked for in both samples.  The
sample is then looked up on the graph, and the beam doubles until the lists that the
walk finds reach that recall, too.

Lists are stored as blocks of at most BLOCK vectors.  A list that is long (one
vector a third of all rows) is dealt to parts by its measured size, and a query
reads all parts of it: nothing is capped.  Queries meet the blocks of their lists
by an equi-join on list and part.

Inner products are turned into distances by one more coordinate, the square root
of the largest squared length less the vector's own; scores are computed on the
original vectors in double precision, row by row, so equal vectors get equal
scores in every block.

Other defined results are those of ``vectors``; a zero vector takes no part;
fewer candidates than k give all that were found; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, scratch, tidily
from lodestone.llm.vectors import best, blob, clean, matrix, width

#: Vectors of a list on average, and most lists, so that they and their graph stay in memory.
LIST_ROWS, MOST_LISTS = 192, 8192
#: Training rows: at least, for each list, and at most.
LEAST_TRAIN, TRAIN_EACH, MOST_TRAIN = 8192, 8, 65_536
PROBES = 256
REPLICAS, SPREAD = 2, 1.04
BLOCK, QUERY_BLOCK = 4096, 512
#: Neighbours of a centroid in the graph, hubs at which a walk begins (its nearest), and the least beam.
DEGREE, ENTRIES, BEAM = 16, 8, 16
#: Pairs a task holds before it reduces them to each query's best.
HELD = 400_000
#: Rows of a part of a long list.
PART_ROWS = 32_768


def hubs(c: np.ndarray, n: int) -> np.ndarray:
    """n rows far apart: each next one is the farthest from those before, so that groups that lie apart have one each."""
    chosen = [0]
    away = ((c - c[0]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((c - c[chosen[-1]]) ** 2).sum(1))
    return np.unique(chosen)


class Graph:
    """Centroids with a neighbour graph; finds the nearest centroids of many points at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.sq = (centroids**2).sum(1)
        k = len(centroids)
        degree = min(DEGREE, k - 1)
        near = np.empty((k, degree), dtype=np.int64)
        for a in range(0, k, 512):
            dist = self.sq[None, :] - 2 * centroids[a : a + 512] @ centroids.T
            dist[np.arange(len(dist)), np.arange(a, a + len(dist))] = np.inf
            near[a : a + 512] = np.argpartition(dist, degree - 1, axis=1)[:, :degree] if degree else near[a : a + 512]
        # A ring and long links on top of the near neighbours keep every centroid within reach.
        links = [near] + [((np.arange(k) + step) % k)[:, None] for step in sorted({1, k // 3, k // 7}) if step]
        self.links = np.concatenate(links, axis=1)
        self.hubs = hubs(centroids, min(k, max(ENTRIES, 2 * int(k**0.5))))
        self.visited = 0

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices, distances) of about the ``beam`` nearest centroids of each point, nearest first."""
        beam = min(beam, len(self.c))
        parts = [self._walk(points[a : a + 512], beam) for a in range(0, len(points), 512)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, beam), np.int64), np.zeros((0, beam)))

    def _walk(self, p: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all points side by side.  A step takes each point's nearest centroid of its beam that
        isn't open yet and measures its neighbours: the work is the beam times the degree, whatever the number of centroids."""
        n, k = len(p), len(self.c)
        rows = np.arange(n)
        seen = np.zeros((n, k), dtype=bool)
        own = (p**2).sum(1)

        def measured(who: np.ndarray, which: np.ndarray) -> np.ndarray:
            """Squared distances; infinite for centroids met before and repeats."""
            fresh = ~seen[who[:, None], which]
            order = np.argsort(which, axis=1, kind="stable")
            again = np.zeros_like(fresh)
            ranked = np.take_along_axis(which, order, axis=1)
            np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
            fresh &= ~again
            seen[who[:, None], which] = True
            a, b = np.nonzero(fresh)
            self.visited += len(a)
            dist = np.full(which.shape, np.inf)
            c = which[a, b]
            dist[a, b] = np.maximum(0, own[who[a]] + self.sq[c] - 2 * np.einsum("ij,ij->i", p[who[a]], self.c[c]))
            return dist

        first = min(ENTRIES, len(self.hubs))
        width = max(beam, first)
        ids = np.zeros((n, width), dtype=np.int64)
        dist = np.full((n, width), np.inf)
        opened = np.zeros((n, width), dtype=bool)
        far = self.sq[self.hubs] - 2 * p @ self.c[self.hubs].T
        start = self.hubs[np.argpartition(far, first - 1, axis=1)[:, :first]]
        ids[:, :first], dist[:, :first] = start, measured(rows, start)
        live = rows
        while len(live):
            todo = np.where(opened[live], np.inf, dist[live])
            at = todo.argmin(axis=1)
            going = np.isfinite(todo[np.arange(len(live)), at])
            live, at = live[going], at[going]
            if not len(live):
                break
            opened[live, at] = True
            which = self.links[ids[live, at]]
            found = measured(live, which)
            # The nearest ``width`` of the beam and what was found; all of them opened ends a point's walk.
            d = np.concatenate([dist[live], found], axis=1)
            keep = np.argpartition(d, width - 1, axis=1)[:, :width]
            dist[live] = np.take_along_axis(d, keep, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], which], axis=1), keep, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros_like(found, dtype=bool)], axis=1), keep, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))


def train(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids by k-means with a penalty for full lists, which balances them."""
    rng = np.random.default_rng(20)
    distinct = np.unique(sample, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    penalty, at = np.zeros(k), np.zeros(len(distinct), dtype=np.int64)
    for _ in range(rounds):
        sq, scale = (centroids**2).sum(1) + penalty, 0.0
        for a in range(0, len(distinct), 2048):
            dist = sq[None, :] - 2 * distinct[a : a + 2048] @ centroids.T
            at[a : a + 2048] = dist.argmin(axis=1)
            scale += float(np.abs(dist).mean()) * len(dist) / len(distinct)
        sizes = np.bincount(at, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, distinct)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        centroids[~full] = distinct[rng.choice(len(distinct), int((~full).sum()))]
        penalty += 0.02 * scale * (sizes / max(1.0, len(distinct) / k) - 1).clip(-1, 1)
    return centroids


def lift(m: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate, so that all vectors have length ``top``."""
    return np.concatenate([m, np.sqrt(np.maximum(0, top * top - (m * m).sum(1)))[:, None]], axis=1)


def aim(q: np.ndarray, top: float) -> np.ndarray:
    """Queries at length ``top``, which changes no order, with 0 as the last coordinate."""
    return np.concatenate([q * (top / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 1))], axis=1)


def nearest(q_ids, q, ids, m, k: int) -> list[tuple]:
    """(query ids, ids, scores) of the k best of a block for each query; the block's ids ascend."""
    rough = q @ m.T
    give = 1e-9 * (1 + np.abs(rough).max(initial=0))
    at = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
    own = np.flatnonzero(ids[at] == q_ids)
    rough[own, at[own]] = -np.inf
    if len(ids) > k + 1:
        edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - give
        fit = rough >= edge[:, None]
    else:
        fit = np.isfinite(rough)
    out = []
    many = np.flatnonzero(fit.sum(axis=1) > 4 * k)  # ties: one query at a time
    for i in many.tolist():
        c = np.flatnonzero(fit[i] & np.isfinite(rough[i]))
        score = (m[c] * q[i]).sum(axis=1)
        top = best(score, ids[c], k)
        out.append((np.full(len(top), q_ids[i]), ids[c][top], score[top]))
    fit[many] = False
    row, col = np.nonzero(fit & np.isfinite(rough))
    if len(row):
        out.append((q_ids[row], ids[col], (m[col] * q[row]).sum(axis=1)))
    return out


def leading(found: list[tuple], k: int) -> tuple:
    """The k best of each query, without repeated pairs."""
    query, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    once = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])])
    query, ids, score = query[once], ids[once], score[once]
    begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(query)]])))
    return query[rank < k], ids[rank < k], score[rank < k]


def wanted(graph: Graph, point: np.ndarray, ratio: float, beam: int, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, list): the lists that each point reads, by a walk with a beam that widens while the last list found still counts."""
    todo = np.arange(len(point))
    met: list[tuple[np.ndarray, np.ndarray]] = []
    while len(todo):
        which, dist = graph.search(point[todo], beam)
        held = np.cumsum(sizes[which], axis=1)
        short = held - sizes[which] < REPLICAS * (k + 1)  # lists without which k others might not be found
        near = ((dist <= ratio * dist[:, :1] + 1e-12) | short) & np.isfinite(dist)
        more = near[:, -1] & (beam < len(graph.c))
        row, col = np.nonzero(near & ~more[:, None])
        met.append((todo[row], which[row, col]))
        todo, beam = todo[more], 2 * beam
    row, lists = (np.concatenate(x) for x in zip(*met, strict=True))
    return row, lists


class Index:
    """Posting lists over all vectors of a table, in the shared folder."""

    def __init__(self, rows: DataFrame, own: Scratch, k: int = 20, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding", asked: Column | None = None):
        """``asked``: which rows (vec_id) will be queries; all of them if not said."""
        self.spark, self.k = rows.sparkSession, k
        found = clean(rows, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
        self.vectors = own.put(found, "vectors")
        self.d = width(self.vectors)
        if not self.d:
            return
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        size = self.vectors.agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("top")).first()
        self.n, self.top = size["n"], size["top"]
        lists = min(MOST_LISTS, max(1, self.n // LIST_ROWS))
        # At most MOST_TRAIN rows come to the driver.
        some = self.vectors.orderBy(F.xxhash64("vec_id", F.lit(20))).limit(min(MOST_TRAIN, max(LEAST_TRAIN, TRAIN_EACH * lists)))
        self.graph = Graph(train(lift(self._local(some)[1], self.top), lists))
        shared = self.spark.sparkContext.broadcast(self.graph)
        d, top = self.d, self.top

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, home = Index._homes(shared.value, lift(matrix(batch.column(1), d), top))
                row, col = np.nonzero(home)
                yield pa.RecordBatch.from_arrays([pa.array(which[row, col].astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "vec_id", "v"])

        placed = own.put(self.vectors.select("vec_id", "v").mapInArrow(tidily(homes), "list int, vec_id long, v array<double>"), "placed")
        # One row per list, MOST_LISTS at most.
        sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
        self.parts = {i: -(-n // PART_ROWS) for i, n in sizes.items()}
        self.sizes = np.zeros(len(self.graph.c), dtype=np.int64)
        self.sizes[list(sizes)] = list(sizes.values())
        self.longest = max(sizes.values(), default=0)
        self.beam = 4 * BEAM
        self.ratio = self._fit(recall, F.lit(True) if asked is None else asked)
        self.lists = own.put(self._blocks(placed), "lists")

    def _local(self, some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = some.select("vec_id", "v").toArrow()
        return t.column("vec_id").to_numpy(), matrix(t.column("v").combine_chunks(), self.d)

    @staticmethod
    def _homes(graph: Graph, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each point and which of them count."""
        which, dist = graph.search(points, max(BEAM, REPLICAS))
        which, dist = which[:, :REPLICAS], dist[:, :REPLICAS]
        return which, (dist <= SPREAD * dist[:, :1] + 1e-12) & np.isfinite(dist)

    def _blocks(self, placed: DataFrame) -> DataFrame:
        """list, part, ids, m: blocks of the posting lists; a long list has several parts."""
        d = self.d
        long = {i: n for i, n in self.parts.items() if n > 1}
        parts = F.coalesce(F.create_map(*(F.lit(x) for pair in sorted(long.items()) for x in pair))[F.col("list")], F.lit(1)) if long else F.lit(1)

        def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, part, ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), d)
                cuts = np.concatenate([[0], np.flatnonzero((np.diff(lists) != 0) | (np.diff(part) != 0)) + 1, [len(lists)]])
                rows = [(lists[a], part[a], s, min(b, s + BLOCK)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for s in range(a, b, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([blob(ids[a:b]) for *_, a, b in rows], pa.binary()), pa.array([blob(m[a:b]) for *_, a, b in rows], pa.binary())], ["list", "part", "ids", "m"])

        dealt = placed.select("list", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), "vec_id", "v")
        return dealt.repartition("list", "part").sortWithinPartitions("list", "part", "vec_id").mapInArrow(tidily(to_blocks), "list int, part int, ids binary, m binary")

    def _fit(self, recall: float, asked: Column) -> float:
        """The distance ratio at which both samples of queries find ``recall`` of their true neighbours; sets the beam that finds their lists."""
        if len(self.graph.c) == 1:
            return 1.0
        d, k = self.d, self.k
        rows = self.vectors.where(asked)
        apart = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v")
        samples = [self._local(some.orderBy(F.xxhash64("vec_id", F.lit(21))).limit(PROBES)) for some in (rows, apart)]
        ids, once = np.unique(np.concatenate([i for i, _ in samples]), return_index=True)
        q = np.concatenate([m for _, m in samples])[once]
        if not len(ids):
            return 1.0
        shared = self.spark.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            held: list[tuple] = []
            for batch in batches:
                order = np.argsort(batch.column(0).to_numpy(), kind="stable")
                held += nearest(q_ids, q, batch.column(0).to_numpy()[order], matrix(batch.column(1), d)[order], k)
                held = [leading(held, k)] if held else []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "vec_id", "score"])

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        true = self.vectors.select("vec_id", "v").mapInArrow(tidily(scan), "query_id long, vec_id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)
        t = true.join(self.vectors, "vec_id").select("query_id", "v").toArrow()  # 2 * PROBES * k rows at most
        which, home = Index._homes(self.graph, lift(matrix(t.column("v").combine_chunks(), d), self.top))
        of = np.searchsorted(ids, t.column("query_id").to_numpy())
        c, p = self.graph.c, aim(q, self.top)
        dist = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * p @ c.T))
        need = np.where(home, dist[of[:, None], which], np.inf).min(axis=1) / np.maximum(dist.min(axis=1)[of], 1e-12)
        own = [np.isin(ids[of], i) for i, _ in samples]
        own = [o for o in own if o.any()]
        if not own:
            return 1.0
        ratio = max(float(np.quantile(need[o], recall, method="higher")) for o in own) * (1 + 1e-9)
        while True:  # a beam of all centroids finds every list
            row, lists = wanted(self.graph, p, ratio, self.beam, self.sizes, k)
            read = np.zeros(dist.shape, dtype=bool)
            read[row, lists] = True
            found = (read[of[:, None], which] & home).any(axis=1)
            if self.beam >= len(c) or min(float(found[o].mean()) for o in own) >= recall - 0.01:
                return ratio
            self.beam *= 2

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score; ``queries``: vec_id, v as ``self.vectors`` has them."""
        d, k, top, ratio, parts, sizes, beam = self.d, self.k, self.top, self.ratio, self.parts, self.sizes, self.beam
        shared = self.spark.sparkContext.broadcast(self.graph)

        def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, QUERY_BLOCK):
                    own = batch.slice(start, QUERY_BLOCK)
                    ids, q = own.column(0).to_numpy(), matrix(own.column(1), d)
                    row, lists = wanted(graph, aim(q, top), ratio, beam, sizes, k)
                    order = np.argsort(lists, kind="stable")
                    row, lists = row[order], lists[order]
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]]).tolist()
                    rows = [(int(lists[a]), part, row[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for part in range(parts.get(int(lists[a]), 0))]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in rows], pa.int32()), pa.array([n for _, n, _ in rows], pa.int32()), *(pa.array([blob(x[r]) for _, _, r in rows], pa.binary()) for x in (ids, q))], ["list", "part", "q_ids", "q"])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0
            for batch in batches:
                for i in range(batch.num_rows):
                    q_ids, q, ids, m = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, np.float64, np.int64, np.float64)))
                    own = nearest(q_ids, q.reshape(-1, d), ids, m.reshape(-1, d), k)
                    held += own
                    size += sum(len(x[0]) for x in own)
                    if size > HELD:
                        held = [leading(held, k)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "vec_id", "score"])
                            held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in leading(held, k)], ["query_id", "vec_id", "score"])

        probes = queries.select("vec_id", "v").mapInArrow(tidily(aimed), "list int, part int, q_ids binary, q binary")
        pairs = probes.join(self.lists, ["list", "part"]).select("q_ids", "q", "ids", "m")
        found = pairs.mapInArrow(tidily(find), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ann_topk(rows: DataFrame, k: int = 20, every: int = 20, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found for every row whose id is divisible by ``every``."""
    with scratch(rows.sparkSession, "ann", 10_000) as own:
        index = Index(rows, own, k, recall, id_col, vec_col, F.col("vec_id") % every == 0)
        if not index.d:
            return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return own.keep(index.search(index.vectors.where(F.col("vec_id") % every == 0)), "found")
