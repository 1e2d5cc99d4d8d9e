"""Vector search in blocks: exact by matrix products, approximate by hyperplane buckets on disk.

A block of queries meets a block of rows in one task: one matrix product, and only
each query's best (or a loss's partial sums) leave it.  No pair of vectors is ever a
row.  Blocks have a bounded number of rows, whatever the tables' sizes.  For the best,
products are made in single precision first, and only those that its error and the
rounding can put among a query's best are scored as SQL does.

``HyperplaneIndex`` puts every row in the bucket of its signs against ``bits`` seeded
hyperplanes and writes the rows by bucket.  A query reads buckets in the order of the
margins that it would have to cross (multi-probe): the squared distances to the
planes whose signs differ, summed.  A bucket that holds a third of all rows is many
blocks, so it is many tasks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
#: Numbers in the vectors of a block of nearest rows; there are LEAST_BLOCKS blocks where each keeps LEAST_ROWS rows.
NEAR_NUMBERS, LEAST_BLOCKS, LEAST_ROWS = 4_194_304, 8, 2_048
#: Queries and rows of a tile, whose products are made at once and stay in the cache; a greater share of candidates than DENSE is not taken one by one.
TILE_QUERIES, TILE_ROWS, DENSE = 512, 1_024, 0.03
#: Candidates of a row that are put among its best one after the other; more are sorted.
ROUNDS = 24
#: Pairs of a query and a row that a task holds at once.
SLICE = 1_000_000
#: Rows of a file of a bucket.
FILE_ROWS = 1_000_000

Block = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table], pa.Table]


def _matrix(column: pa.ChunkedArray, kind: type | None = np.float64) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if kind is None and flat.dtype == np.float32 else flat.astype(kind or np.float64)).reshape(len(column), -1)


def whole(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def dealt(name: str, parts: int | Column) -> Column:
    """The part of a name, an int on both sides: a cogroup doesn't cast its keys, and an int and a long of one value go to different tasks."""
    return F.pmod(F.xxhash64(name), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def by_blocks(queries: DataFrame, rows: DataFrame, block: Block, schema: str, rounded: int = 6) -> DataFrame:
    """``block`` of every block of queries (query, q, ...) and every block of rows (id, v).

    ``block`` is given query names, row names, a mask of pairs of a query and itself,
    their inner products rounded to ``rounded`` digits, and the queries' table.
    Vectors that are null or hold a null or non-finite component take no part.
    """
    queries, rows = whole(queries, "q"), whole(rows.select("id", "v"), "v")
    few, many = queries.count(), rows.count()
    parts, blocks = max(1, -(-few // BLOCK_QUERIES)), max(1, -(-many // BLOCK_ROWS))
    left = queries.withColumn("_q", dealt("query", parts)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("_r", dealt("id", blocks)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(_task(block, rounded, schema), schema)


def products(q: np.ndarray, v: np.ndarray, digits: int) -> np.ndarray:
    """Inner products rounded half away from zero; what lies so near a half that the order of a sum decides is summed in order, as SQL does."""
    return _rounded(q @ v.T, np.abs(q).max(initial=0) * np.abs(v).max(initial=0), digits, q.shape[1], lambda at: (q[at // len(v)], v[at % len(v)]))


def _rounded(rough: np.ndarray, size: float, digits: int, n: int, pairs: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of ``n`` products of at most ``size``, as ``products`` rounds them; ``pairs`` gives the vectors of some places in the flat array."""
    scale = 10.0**digits
    rough = rough * scale
    whole = np.trunc(rough)
    part = np.abs(rough - whole)
    near = np.flatnonzero(np.abs(part - 0.5) <= np.abs(size) * n * scale * n * 2.0**-51)
    out = whole + np.where(part >= 0.5, np.sign(rough), 0.0)
    for a in range(0, len(near), SLICE):
        left, right = pairs(near[a : a + SLICE])
        exact = np.zeros(len(left))
        for d in range(n):
            exact += left[:, d].astype(np.float64) * right[:, d]
        exact *= scale
        low = np.trunc(exact)
        out.flat[near[a : a + SLICE]] = low + np.where(np.abs(exact - low) >= 0.5, np.sign(exact), 0.0)
    return out / scale + 0.0


def _task(block: Block, rounded: int, schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({n: [] for n in names}).cast(_arrow(schema))
        asked, ids = left["query"].to_numpy(), right["id"].to_numpy()
        q, v = _matrix(left["q"]), _matrix(right["v"])
        step = max(1, SLICE // len(ids))
        made = []
        for a in range(0, len(asked), step):
            own = asked[a : a + step]
            made.append(block(own, ids, own[:, None] == ids[None, :], products(q[a : a + step], v, rounded), left.slice(a, step)).cast(_arrow(schema)))
        return pa.concat_tables(made)

    return run


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, ties to the smaller column."""
    limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for i, row in enumerate(scores):
        near = np.flatnonzero(row >= limit[i])
        out[i] = near[np.argsort(-row[near], kind="stable")[:k]]
    return out


_BEST = "query long, id long, score double"


def first_of_equals(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of the rows (id, ...) that agree in ``by``, from which their vector is made, the k + 1 of the smallest ids.

    Their scores are equal for every query and ties go to the smaller id, so no other is among a query's k
    best, even if one of them is the query itself.  Tasks keep k + 1 of each before anything is shuffled.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).drop("_rank")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


class _Side:
    """A block's names and vectors by name, and each one's k best of what it has met."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(names, kind="stable")
        self.names, self.v, self.k = names[order], vectors[order], k
        self.size = float(np.abs(self.v).max(initial=0))
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))
        self.score, self.best = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)

    def first_of_equals(self) -> _Side:
        """The side without vectors that have k + 1 equals of smaller names: no other row finds them."""
        bits = self.v.view(np.uint32 if self.v.dtype == np.float32 else np.uint64)
        with np.errstate(over="ignore"):
            hashes = (bits * np.random.default_rng(7).integers(1, 2**63, bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        new = np.append(True, hashes[order][1:] != hashes[order][:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        more = np.arange(len(order)) - first > self.k
        surplus = order[more][(bits[order[more]] == bits[order[first[more]]]).all(axis=1)]
        # Those before a surplus row count only if they are equal to it: they are, unless hashes meet.
        odd = np.unique(first[(bits[order] != bits[order[first]]).any(axis=1)])
        surplus = np.setdiff1d(surplus, order[np.isin(first, odd)])
        if not len(surplus):
            return self
        left = np.ones(len(self.names), dtype=bool)
        left[surplus] = False
        return _Side(self.names[left], self.v[left], self.k)

    def add(self, i: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """Names and scores that rows ``i`` have met; ties go to the smaller name."""
        order = np.argsort(i, kind="stable")
        i, names, scores = i[order], names[order], scores[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        count = np.diff(np.append(first, len(i)))
        rows = i[first]
        if count.max() > ROUNDS:
            places = np.concatenate([np.repeat(rows, self.k), i])
            every, found = np.concatenate([self.score[rows].ravel(), scores]), np.concatenate([self.best[rows].ravel(), names])
            order = np.lexsort((found, -every, places))
            take = order[(np.searchsorted(places[order], rows)[:, None] + np.arange(self.k)).ravel()]
            self.score[rows], self.best[rows] = every[take].reshape(-1, self.k), found[take].reshape(-1, self.k)
            return
        for n in range(count.max()):  # each row's next one is put between its best
            some = count > n
            at, row = first[some] + n, rows[some]
            s, m, old, own = scores[at, None], names[at, None], self.score[row], self.best[row]
            better = (old > s) | ((old == s) & (own < m))
            after = np.empty_like(better)
            after[:, 0], after[:, 1:] = True, better[:, :-1]  # the new one lies behind all that are better
            self.score[row] = np.where(better, old, np.where(after, s, np.roll(old, 1, axis=1)))
            self.best[row] = np.where(better, own, np.where(after, m, np.roll(own, 1, axis=1)))

    def found(self) -> pa.Table:
        kept = self.score > -np.inf
        return pa.table({"query": np.repeat(self.names, self.k)[kept.ravel()], "id": self.best[kept], "score": self.score[kept]})


def _places(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask that is nearly empty: eight places are looked at as one number."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[some])
    return some[i] * 8 + j


class _Seeker:
    """Finds what can be among the k best of a side's rows in tiles of rough products.

    A row's limit is its k-th best rounded score, less what rounding and a rough product can hide; before there
    are k, the k-th greatest of the maxima of parts of the first tile.
    """

    def __init__(self, own: _Side, other: _Side, digits: int, error: float):
        self.own, self.other, self.digits = own, other, digits
        self.error = own.length * other.length.max(initial=0) * error
        self.half = 0.5000001 * 10.0**-digits
        self.limit = np.full(len(own.names), -np.inf)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []

    def seek(self, tile: np.ndarray, a: int, b: int, kind: type, axis: int) -> None:
        """``tile``: products of own rows from ``a`` and others from ``b``; ``axis``: that of the others."""
        own, k = self.own, self.own.k
        n, m = tile.shape[1 - axis], tile.shape[axis]
        limit = self.limit[a : a + n]
        if np.isneginf(limit).any() and m >= 4 * k:
            parts = np.linspace(0, m, min(m, 4 * k) + 1).astype(np.int64)[:-1]
            tops = np.maximum.reduceat(tile, parts, axis=axis)
            bound = np.partition(tops, len(parts) - k, axis=axis).take(len(parts) - k, axis=axis)
            limit = np.maximum(limit, bound - 2 * self.error[a : a + n] - 2 * self.half)
            self.limit[a : a + n] = limit
        low = limit.astype(kind)
        low = np.nextafter(low, kind(-np.inf), dtype=kind)
        at = _places(tile > (low[:, None] if axis else low[None, :]))  # a row itself is -inf, and never above
        if len(at) > DENSE * tile.size and m > 4 * k:
            at = self._dense(tile, a, b, axis)
        if len(at):
            i, j = np.divmod(at, tile.shape[1])
            self.pending.append((i + a, j + b) if axis else (j + a, i + b))

    def _dense(self, tile: np.ndarray, a: int, b: int, axis: int) -> np.ndarray:
        """The places of each own row's k best of a tile by rounded products, without those of -inf."""
        n, m = tile.shape[1 - axis], tile.shape[axis]
        scores = products(self.own.v[a : a + n].astype(np.float64), self.other.v[b : b + m].astype(np.float64), self.digits)
        scores[np.isneginf(tile if axis else tile.T)] = -np.inf
        take = _top(scores, self.own.k)
        i, j = np.repeat(np.arange(n), self.own.k), take.ravel()
        kept = scores[i, j] > -np.inf
        i, j = i[kept], j[kept]
        return i * tile.shape[1] + j if axis else j * tile.shape[1] + i

    def settle(self, least: int = 1) -> None:
        """Score what is pending, if that are ``least`` pairs, and raise the limits."""
        if sum(len(i) for i, _ in self.pending) < least:
            return
        own, other, n = self.own, self.other, self.own.v.shape[1]
        i, j = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending = []
        scores = np.empty(len(i))
        step = max(1, SLICE // max(1, n))
        for c in range(0, len(i), step):
            x, y = i[c : c + step], j[c : c + step]
            q, v = own.v[x].astype(np.float64), other.v[y].astype(np.float64)
            scores[c : c + step] = _rounded(np.einsum("nd,nd->n", q, v), own.size * other.size, self.digits, n, lambda at, q=q, v=v: (q[at], v[at]))
        own.add(i, other.names[j], scores)
        rows = np.unique(i)
        self.limit[rows] = np.maximum(self.limit[rows], own.score[rows, -1] - self.half - self.error[rows])


def _meet(left: _Side, right: _Side, digits: int, both: bool = False) -> None:
    """Each left row's best of the right rows, and with ``both`` each right row's of the left; a row's own name is left out."""
    n = left.v.shape[1]
    rough = left.size * right.size
    if not (len(left.names) and len(right.names)):
        return
    if both:
        few, less = left.first_of_equals(), right.first_of_equals()
        if few is not left or less is not right:  # what one side finds no more is still to find the other's
            _meet(left, less, digits)
            _meet(right, few, digits)
            return
    else:
        right = right.first_of_equals()
    kind = np.float32 if left.size < 1e15 and right.size < 1e15 else np.float64
    error = (n + 8) * float(np.finfo(kind).eps)
    q, v = left.v.astype(kind, copy=False), right.v.astype(kind, copy=False)
    sides = [_Seeker(left, right, digits, error if rough * n < 1e290 else np.inf)] + [_Seeker(right, left, digits, error if rough * n < 1e290 else np.inf)] * both
    first, last = np.searchsorted(right.names, left.names), np.searchsorted(right.names, left.names, "right")
    for a in range(0, len(q), TILE_QUERIES):
        asked = q[a : a + TILE_QUERIES]
        own_first, own_last = first[a : a + len(asked)], last[a : a + len(asked)]
        for b in range(0, len(v), TILE_ROWS):
            tile = asked @ v[b : b + TILE_ROWS].T
            for i in np.flatnonzero((own_first < b + tile.shape[1]) & (own_last > b) & (own_first < own_last)).tolist():
                tile[i, max(0, own_first[i] - b) : max(0, own_last[i] - b)] = -np.inf
            for axis, side in zip((1, 0), sides, strict=False):
                side.seek(tile, *((a, b) if axis else (b, a)), kind, axis)
            sides[0].settle(2 * TILE_QUERIES)
        for side in sides:
            side.settle()


def _nearest(k: int, digits: int, itself: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """query, id, score: the k best of a block for each of its queries; ``itself``: blocks (id, v) are both, and one without a partner meets itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        name, vector = ("id", "v") if itself else ("query", "q")
        made = [pa.table({"query": [], "id": [], "score": []})]
        if left.num_rows and (right.num_rows or itself):
            asked = _Side(left[name].to_numpy(), _matrix(left[vector], None), k)
            rows = _Side(right["id"].to_numpy(), _matrix(right["v"], None), k) if right.num_rows else _Side(asked.names, asked.v, k)
            _meet(asked, rows, digits, itself and right.num_rows > 0)
            made += [asked.found()] + [rows.found()] * (itself and right.num_rows > 0)
        return pa.concat_tables([t.cast(_arrow(_BEST)) for t in made])

    return run


def _blocks(rows: DataFrame, vector: str) -> tuple[int, int]:
    """Blocks of nearest rows that a table is dealt to: full ones, and at least so many that tasks are small."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    full = max(1, NEAR_NUMBERS // max(1, r["d"] or 1))
    return max(1, -(-r["n"] // full)), max(1, -(-r["n"] // full), min(LEAST_BLOCKS, -(-r["n"] // LEAST_ROWS)))


def _met(left: DataFrame, right: DataFrame, pairs: int, task: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``task`` of blocks that share a pair (_q, _r); so many partitions that few of them have two pairs."""
    left, right = (x.repartition(4 * pairs, "_q", "_r").groupBy("_q", "_r") for x in (left, right))
    return left.cogroup(right).applyInArrow(task, _BEST)


def knn(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query, rank, id, score: each query's k best rows by inner product, itself left out; queries (query, q), rows (id, v), names are longs.

    Vectors that are null or hold a null or non-finite component take no part.
    """
    asked = whole(queries.select(F.col("query").cast("long").alias("query"), "q"), "q")
    rows = whole(rows.select(F.col("id").cast("long").alias("id"), "v"), "v")
    parts, blocks = _blocks(asked, "q")[0], _blocks(rows, "v")[1]
    left = asked.withColumn("_q", dealt("query", parts)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("_r", dealt("id", blocks)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return ranked(_met(left, right, parts * blocks, _nearest(k, digits)), k)


def knn_of_all(rows: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query, rank, id, score: ``knn`` of every row (id, v) among all; two blocks meet once, for the best of both."""
    rows = whole(rows.select(F.col("id").cast("long").alias("id"), "v"), "v")
    blocks = _blocks(rows, "v")[1]
    own = rows.withColumn("_b", dealt("id", blocks))
    left = own.withColumn("_q", F.col("_b")).withColumn("_r", F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))))
    right = own.withColumn("_r", F.col("_b")).where("_b > 0").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return ranked(_met(left.drop("_b"), right.drop("_b"), blocks * (blocks + 1) // 2, _nearest(k, digits, True)), k)


# --- losses --------------------------------------------------------------------------------


def positive_scores(queries: DataFrame, rows: DataFrame, digits: int = 6) -> DataFrame:
    """query, q, positive: a query (query, q, positive_id) and its product with its positive, null without one."""
    from lodestone.functions.vectors import dot

    met = queries.join(rows.select(F.col("id").alias("positive_id"), "v"), "positive_id", "left")
    return met.select("query", "q", F.round(dot(F.col("q"), F.col("v")), digits).alias("positive"))


def infonce(queries: DataFrame, rows: DataFrame, temperature: float = 0.05, digits: int = 6) -> DataFrame:
    """query, loss: -log of the positive's softmax share among all rows but the query itself.

    queries (query, q, positive_id).  The log of a sum of exponentials is a partial
    aggregate: a block gives its maximum and its sum scaled by that, and sums meet by query.
    """

    def run(asked: np.ndarray, ids: np.ndarray, own: np.ndarray, scores: np.ndarray, left: pa.Table) -> pa.Table:
        t = np.where(own, -np.inf, scores / temperature)
        top = t.max(axis=1)
        safe = np.where(np.isfinite(top), top, 0.0)
        return pa.table({"query": asked, "top": top, "sum": np.exp(t - safe[:, None]).sum(axis=1), "positive": left["positive"]})

    found = by_blocks(positive_scores(queries, rows, digits), rows, run, "query long, top double, sum double, positive double", digits)
    return merged_loss(found.where("sum > 0"), temperature)


def merged_loss(partial: DataFrame, temperature: float, digits: int = 6) -> DataFrame:
    """query, loss of partial sums (query, top, sum, positive)."""
    tops = partial.groupBy("query").agg(F.max("top").alias("most"))
    met = partial.join(tops, "query").groupBy("query").agg(F.first("most").alias("most"), F.sum(F.col("sum") * F.exp(F.col("top") - F.col("most"))).alias("sum"), F.first("positive").alias("positive"))
    return met.select("query", F.round(F.ln("sum") + F.col("most") - F.col("positive") / F.lit(temperature), digits).alias("loss"))


def infonce_of_slices(pairs: DataFrame, temperature: float = 0.05, digits: int = 6) -> DataFrame:
    """query, loss where each query has its own candidates: pairs (query, q, v, is_positive), one row a candidate.

    Candidates are summed where they lie: only (maximum, scaled sum) of a task's part of
    a query is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch)
            t = np.round((_matrix(table["q"]) * _matrix(table["v"])).sum(axis=1), digits) / temperature
            names, where = np.unique(table["query"].to_numpy(), return_inverse=True)
            top = np.full(len(names), -np.inf)
            np.maximum.at(top, where, t)
            total = np.zeros(len(names))
            np.add.at(total, where, np.exp(t - top[where]))
            positive = np.full(len(names), np.nan)
            right = table["is_positive"].to_numpy(zero_copy_only=False).astype(bool)
            positive[where[right]] = t[right] * temperature
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(top), pa.array(total), pa.array(positive, mask=np.isnan(positive))], ["query", "top", "sum", "positive"])

    found = whole(whole(pairs, "q"), "v").select("query", "q", "v", "is_positive").mapInArrow(run, "query long, top double, sum double, positive double")
    positive = found.groupBy("query").agg(F.max("positive").alias("positive"))
    return merged_loss(found.drop("positive").join(positive, "query"), temperature, digits)


def margin_loss(queries: DataFrame, rows: DataFrame, margin: float = 1.0, digits: int = 6) -> DataFrame:
    """loss: the mean of max(0, margin - positive + negative) over all negatives of queries (query, q, positive_id) that have a positive."""

    def run(asked: np.ndarray, ids: np.ndarray, own: np.ndarray, scores: np.ndarray, left: pa.Table) -> pa.Table:
        positive, right = left["positive"].to_numpy(), left["positive_id"].to_numpy()
        negative = ~own & (ids[None, :] != right[:, None])
        lost = np.where(negative, np.maximum(0.0, margin - positive[:, None] + scores), 0.0)
        return pa.table({"sum": [lost.sum()], "n": [int(negative.sum())]})

    met = queries.select("query", "positive_id").join(positive_scores(queries, rows, digits).where("positive IS NOT NULL"), "query")
    found = by_blocks(met, rows, run, "sum double, n long", digits)
    return found.agg(F.round(F.sum("sum") / F.sum("n"), digits).alias("loss"))


def positive_ranks(queries: DataFrame, rows: DataFrame, digits: int = 6) -> DataFrame:
    """query, rank, ndcg of the one positive (query, q, positive_id) among all rows but the query; ties rank behind."""

    def run(asked: np.ndarray, ids: np.ndarray, own: np.ndarray, scores: np.ndarray, left: pa.Table) -> pa.Table:
        positive, right = left["positive"].to_numpy(), left["positive_id"].to_numpy()
        before = ~own & (ids[None, :] != right[:, None]) & (scores >= positive[:, None])
        return pa.table({"query": asked, "n": before.sum(axis=1)})

    met = queries.select("query", "positive_id").join(positive_scores(queries, rows, digits).where("positive IS NOT NULL"), "query")
    ranked = by_blocks(met, rows, run, "query long, n long", digits).groupBy("query").agg((F.sum("n") + 1).alias("rank"))
    return ranked.withColumn("ndcg", F.round(F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0)), 6))


# --- approximate search ------------------------------------------------------------------------


def planes(dimensions: int, bits: int, seed: int = 42) -> np.ndarray:
    """``bits`` hyperplanes' normals, a column each; orthogonal as far as the dimensions go, so that no two signs tell the same."""
    drawn = np.random.default_rng(seed).standard_normal((dimensions, bits))
    if bits <= dimensions:
        drawn, _ = np.linalg.qr(drawn)
    return drawn


def probes(margins: np.ndarray, most: int) -> list[int]:
    """The ``most`` buckets nearest to a query of these margins: its own, then by the sum of squared margins crossed."""
    bits = len(margins)
    own = int(sum(1 << b for b in range(bits) if margins[b] >= 0))
    order = np.argsort(np.abs(margins), kind="stable").tolist()
    cost = (margins**2)[order].tolist()
    out, heap = [own], [(cost[0], (0,))] if bits else []
    while heap and len(out) < most:
        total, flips = heapq.heappop(heap)
        out.append(own ^ sum(1 << order[j] for j in flips))
        last = flips[-1]
        if last + 1 < bits:  # every set of flips once: the last is moved on, or one more is added
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*flips[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*flips, last + 1)))
    return out


class HyperplaneIndex:
    """Vectors on disk by the signs of ``bits`` hyperplanes: at most 2 ** bits folders, and a row a folder of counts."""

    def __init__(self, spark: SparkSession, path: str, normals: np.ndarray, schema: StructType):
        self.spark, self.path, self.normals, self.schema = spark, path, normals, schema

    @classmethod
    def build(cls, rows: DataFrame, path: str, bits: int, seed: int = 42) -> HyperplaneIndex:
        """Write all rows (id, v, and what else they carry); those whose vector isn't whole are left out."""
        rows = whole(rows, "v")
        first = rows.select(F.size("v").alias("n")).first()
        normals = planes(first["n"] if first else 0, bits, seed)

        @F.arrow_udf("int")
        def bucket(vectors: pa.Array) -> pa.Array:
            signs = _matrix(pa.chunked_array([vectors])) @ normals >= 0
            return pa.array(signs @ (1 << np.arange(bits)), pa.int32())

        spread = rows.withColumn("bucket", bucket("v"))
        # A hot bucket is dealt by id as well, so that a task writes no more than about FILE_ROWS of it.
        spread.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(1 + rows.count() // FILE_ROWS))).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/vectors")
        own = cls(rows.sparkSession, path, normals, spread.schema)
        own.spark.createDataFrame([(bits, seed, normals.shape[0], spread.schema.json())], "bits int, seed int, dimensions int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")
        return own

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HyperplaneIndex:
        r = spark.read.parquet(f"{path}/planes").first()
        return cls(spark, path, planes(r["dimensions"], r["bits"], r["seed"]), StructType.fromJson(json.loads(r["columns"])))

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def _asked(self, queries: DataFrame, share: float) -> DataFrame:
        """query, q, bucket: the nearest ``share`` of the buckets of each query."""
        normals, most = self.normals, max(1, round(share * 2 ** self.normals.shape[1]))

        @F.arrow_udf("array<int>")
        def near(vectors: pa.Array) -> pa.Array:
            margins = _matrix(pa.chunked_array([vectors])) @ normals if len(normals) else np.zeros((len(vectors), normals.shape[1]))  # an empty index
            return pa.array([probes(m, most) for m in margins], pa.list_(pa.int32()))

        return whole(queries.select(F.col("query").cast("long").alias("query"), "q"), "q").withColumn("bucket", F.explode(near("q")))

    def search(self, queries: DataFrame, k: int, share: float = 0.5, digits: int = 6, where=None) -> DataFrame:
        """query, rank, id, score: the k best in the nearest ``share`` of the buckets; ``where``: a filter of the rows that comes before the search."""
        rows = self.rows if where is None else self.rows.where(where)
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("int")
        keys = ["bucket", "_q", "_r"]
        asked = self._asked(queries, share).withColumn("_q", dealt("query", max(1, -(-queries.count() // BLOCK_QUERIES))))
        sized = F.broadcast(sizes.select("bucket", blocks.alias("blocks")))  # a row a bucket, at most 2 ** bits
        left = asked.join(sized, "bucket").withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query", "q", *(F.col(c).alias(c) for c in keys))
        met = asked.select("bucket", "_q").distinct()
        right = rows.select(F.col("id").cast("long").alias("id"), "v", "bucket").join(sized, "bucket").withColumn("_r", dealt("id", F.col("blocks"))).join(met, "bucket").select("id", "v", *(F.col(c).alias(c) for c in keys))
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k, digits), _BEST)
        return ranked(found, k)

    def read_share(self, queries: DataFrame, share: float = 0.5) -> float:
        """The mean share of all rows that a query's buckets hold."""
        sizes = self.rows.groupBy("bucket").agg(F.count("*").alias("n"))
        total = max(1, self.rows.count())
        per = self._asked(queries, share).join(F.broadcast(sizes), "bucket", "left").groupBy("query").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return (per.agg(F.avg("n")).first()[0] or 0.0) / total


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (query, id) that ``found`` (query, id) has."""
    r = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.sum("hit").alias("hit"), F.count("*").alias("n")).first()
    return (r["hit"] or 0) / max(1, r["n"])
