"""Exact n-gram Jaccard join (operator 9).

Method: grouped prefix join.  Every document becomes its set of distinct word
shingles, hashed to 64 bits.  Equal sets are collapsed first.  Shingles have one
global order, by how many sets have them if frequent (rare ones first), then by hash; two sets whose Jaccard
similarity reaches num/den share a shingle among the first n - ceil(n*num/den) + 1
of each.  Sets with the same size and the same prefix form one group, which is
posted once; pairs of groups that share a posted shingle and pass the size and
position filters are expanded to their members.  Members are compared by odd
sketches (parities of hash buckets: two sketches differ in no more bits than the
sets have unshared shingles), and what is left is verified on whole sets.

Where a shingle (or a group) is shared by more than BUCKET sets, members are first
compared with a few hubs only; what that links is one component.  After that only
pairs from different components are compared, so every component is exact, while
no pair inside one is expanded.

Frequent shingles (more than BUCKET sets) are counted over all sets, on the POOL
smallest hashes of each, which is where prefixes come from.  The order of
shingles may be any, so a bound on how many count as frequent costs speed, never
a pair.  A set whose pool doesn't hold its prefix (nearly all of it is frequent:
copies of copies) is read again in full.

Defined results: null text, empty text and text without words: no shingles, linked
with nothing, its own component.  A null id links with nothing and has a null
component.  Repeated rows are equal sets.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch, scratch, tidily
from lodestone.llm.shingles import sets_of

#: Sets that may share a shingle without hubs.
BUCKET = 40
#: Shingles that may count as frequent; they are sent to every task (12 bytes each).
MOST_FREQUENT = 2_000_000
#: Bytes that may be sent to every task to pick documents; more are joined instead, which shuffles texts.
MOST_SENT = 64 << 20
#: Bytes of a row that is sent, in Spark's hash map: a long alone, and (doc, set_id, sig).
KEY_BYTES, SET_BYTES = 56, 128
#: Hubs of a list in each round, before pairs of different components are compared in full.
HUBS = (1, 16)
#: Earlier shingles of its set that a row carries where pairs of different components are compared.
EARLIER = 32
#: Longs of the sketch by which joins of long lists leave out pairs that can't link.
SKETCH = 8
#: Bits of a row's number below its task's.
ROW_SHIFT = 40
#: Shingles counted together in one task.
COUNTED = 500_000


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n + (-(n * num) // den) + 1


def _pool_size(n: int, num: int, den: int) -> int:
    """Half more than a prefix has, and 8."""
    return min(n, n * 3 * (den - num) // (2 * den) + 8)


def odd_sketch(own: np.ndarray) -> bytes:
    """Parities of hash buckets: a power of two of bits, as many as shingles at least and 64 at least."""
    size = max(64, 1 << max(0, len(own) - 1).bit_length())
    bits = np.bincount((own >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def small_sketch(own: np.ndarray) -> np.ndarray:
    """An odd sketch of SKETCH longs, for joins."""
    bits = np.bincount((own >> np.uint64(9)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter one's size."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _signature(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _binaries(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _twin(id_col: str, text_col: str) -> Column:
    """A row's key: 64 bits of its id and text, so that of two rows a wrong one is taken for the other once in 2 ** 64."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(id_col).isNull())


def _documents(docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), doc_id, twin (its key), n, sig, pool (the smallest hashes, ascending), odd and small (sketches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << ROW_SHIFT
        for batch in batches:
            n, sig, pool, odd, small = [], [], [], [], []
            for own in sets_of(batch.column(1), size):
                n.append(len(own))
                sig.append(_signature(own))
                pool.append(own[: _pool_size(len(own), num, den)])
                odd.append(odd_sketch(own))
                small.append(small_sketch(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), _binaries(pool), pa.array(odd, pa.binary()), pa.array(small, pa.list_(pa.int64()))], ["row", "doc_id", "twin", "n", "sig", "pool", "odd", "small"])
            row += len(n)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _twin(id_col, text_col).alias("twin")).mapInArrow(tidily(run), "row long, doc_id long, twin long, n long, sig binary, pool binary, odd binary, small array<long>")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than BUCKET sets have, MOST_FREQUENT at most, ascending, and their counts."""
    total = sets.agg(F.sum(F.octet_length("pool")).alias("n")).first()["n"] or 0
    parts = max(1, int(total) // 8 // COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(np.frombuffer(blob, np.uint64))
                size += len(held[-1])
            if size >= COUNTED:
                yield put(np.concatenate(held))
                held, size = [], 0
        if held:
            yield put(np.concatenate(held))

    def put(keys: np.ndarray) -> pa.RecordBatch:
        keys, counts = np.unique(keys, return_counts=True)
        cuts = np.searchsorted(keys, np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int32()), _binaries(np.split(keys, cuts)), _binaries(np.split(counts.astype(np.uint32), cuts))], ["part", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys, counts = np.concatenate([keys, np.frombuffer(k, np.uint64)]), np.concatenate([counts, np.frombuffer(c, np.uint32)])
                if len(keys) > 4 * COUNTED:
                    keys, counts = summed(keys, counts)
        keys, counts = summed(keys, counts)
        hot = counts > BUCKET
        yield pa.RecordBatch.from_arrays([pa.array(keys[hot].view(np.int64)), pa.array(counts[hot])], ["key", "n"])

    def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return keys, counts
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(counts, at)

    found = sets.select("pool").mapInArrow(tidily(count), "part int, keys binary, counts binary").repartitionById(parts, F.col("part")).mapInArrow(tidily(add), "key long, n long")
    most = found.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
    keys, counts = most.column("key").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(keys, kind="stable")
    return keys[order], np.minimum(counts[order], (1 << 32) - 1).astype(np.uint32)


def _counts(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many sets have each shingle if it is frequent, else 0."""
    keys, counts = frequent
    if not len(keys):
        return np.zeros(len(own), dtype=np.uint32)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, counts[at], 0)


def _texts_of(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set_id, sig, text of the documents that ``sets`` (set_id, doc, sig) come from: sent to every task if few, joined if not.

    A repeated id may bring texts of other sets; whoever reads a text compares its signature.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(F.broadcast(sets) if sets.count() * SET_BYTES <= MOST_SENT else sets, "doc")
    return found.select("set_id", "sig", "text")


class Join:
    """The sets of a table of documents, and the links between them.

    A set's id is the number of a row that has it, so rows with one doc_id and different texts are different sets.
    """

    def __init__(self, docs: DataFrame, own: Scratch, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.size, self.num, self.den, self.cols = docs, size, num, den, (id_col, text_col)
        self.spark, self.own = docs.sparkSession, own
        self.documents = own.put(_documents(docs, size, num, den, id_col, text_col), "documents")
        known = self.documents.where("n > 0 AND doc_id IS NOT NULL")
        self.sets = own.put(known.groupBy("n", "sig").agg(F.min("row").alias("set_id"), F.min_by("doc_id", "row").alias("doc"), F.min("doc_id").alias("least"), F.first("pool").alias("pool"), F.first("odd").alias("odd"), F.first("small").alias("small")), "sets")
        self.frequent = self.spark.sparkContext.broadcast(_frequent(self.sets))

    # -- prefixes

    def _prefixes(self) -> DataFrame:
        """set_id, n, prefix (hashes in the global order); a set that needs more than its pool is read in full."""
        num, den, size, shared = self.num, self.den, self.size, self.frequent

        def from_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column(1).to_numpy()
                out = []
                for own, p, count in zip(batch.column(3).to_pylist(), prefix_size(n, num, den).tolist(), n.tolist(), strict=True):
                    own = np.frombuffer(own, np.uint64)
                    often = _counts(own, shared.value)
                    whole = len(own) == count
                    ready = whole or int((often == 0).sum()) >= p
                    out.append(own[np.argsort(often, kind="stable")[:p]].tobytes() if ready else None)
                # What has its prefix needs no signature any more.
                sig = pc.if_else(pc.is_null(prefix := pa.array(out, pa.binary())), batch.column(2), None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), sig, prefix], ["set_id", "n", "doc", "sig", "prefix"])

        def in_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, n, out = [], [], []
                for i, (own, sig) in enumerate(zip(sets_of(batch.column(2), size), batch.column(1).to_pylist(), strict=True)):
                    if _signature(own) == sig:
                        p = int(prefix_size(np.int64(len(own)), num, den))
                        order = np.argsort(_counts(own, shared.value), kind="stable")
                        at.append(i), n.append(len(own)), out.append(own[order[:p]].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["set_id", "n", "prefix"])

        made = self.sets.select("set_id", "n", "sig", "pool", "doc").mapInArrow(tidily(from_pool), "set_id long, n long, doc long, sig binary, prefix binary")
        made = self.own.put(made, "prefixes")
        texts = _texts_of(self.docs, made.where("prefix IS NULL").select("set_id", "doc", "sig"), *self.cols)
        full = texts.mapInArrow(tidily(in_full), "set_id long, n long, prefix binary").dropDuplicates(["set_id"])
        return made.where("prefix IS NOT NULL").select("set_id", "n", "prefix").union(full)

    # -- candidates

    def _near(self, a: str, b: str) -> Column:
        """Sizes and places of a shared shingle allow a link of two different sets.

        At the first shingle in the global order that two sets share, all before it are
        unshared; sets of n and m shingles that link have at most
        (n + m) * (den - num) / (den + num) unshared ones.
        """
        n, m, i, j = (F.col(f"{x}.{y}") for y in ("n", "pos") for x in (a, b))
        unshared = F.greatest(i + j, n + m - F.lit(2) * F.least(n - i, m - j), F.lit(1))
        return unshared * (self.den + self.num) <= (n + m) * (self.den - self.num)

    def _alike(self) -> Column:
        """The small sketches differ in no more bits than sets that link may have unshared shingles."""
        bits = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
        return bits * (self.den + self.num) <= (F.col("a.n") + F.col("b.n")) * (self.den - self.num)

    def links(self) -> DataFrame:
        """a, b: set ids; every component of the full join is one of these links, and each is verified."""
        prefixes = self._prefixes().withColumn("key", F.md5("prefix"))
        many = prefixes.groupBy("n", "key").agg(F.min("set_id").alias("group_id"), F.count("*").alias("members")).where("members > 1")
        # Groups of one need no row here.
        grouped = self.own.put(prefixes.select("set_id", "n", "key").join(many, ["n", "key"]).select("set_id", "n", "group_id", "members"), "groups")
        posted = self._posted(prefixes.select("set_id", "n", "prefix").join(grouped.where("set_id <> group_id").select("set_id"), "set_id", "left_anti"))
        # Postings of shingles that more than one group has; counted before the shuffle, and joined, so that a shingle of very many groups can be split.
        posted = self.own.put(posted, "posted")
        shares = posted.groupBy("token").agg(F.count("*").alias("share")).where("share > 1")
        posted = self.own.put(posted.join(shares, "token"), "postings")
        few, hot = posted.where(F.col("share") <= BUCKET), posted.where(F.col("share") > BUCKET)
        inside = grouped.select(F.col("group_id").alias("token"), "set_id", "n", F.lit(0).cast("long").alias("pos"), F.col("members").alias("share"))

        pairs = few.alias("a").join(few.alias("b"), "token").where((F.col("a.set_id") < F.col("b.set_id")) & self._near("a", "b")).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()
        grouped = grouped.select("group_id", "set_id")
        for end in ("a", "b"):  # every member of either group
            pairs = pairs.join(grouped.withColumnRenamed("group_id", end), end, "left").withColumn(end, F.coalesce("set_id", end)).drop("set_id")
        # What a shingle of many groups, or a group of many members, asks for: hubs first, then pairs across components.
        wide = grouped.join(hot.withColumnRenamed("set_id", "group_id"), "group_id").select("token", "set_id", "n", "pos", "share")
        lone = hot.join(grouped.select(F.col("set_id")), "set_id", "left_anti").select("token", "set_id", "n", "pos", "share")
        lists = self.own.put(wide.union(lone).unionByName(inside), "lists")
        links, tried = self._verified(pairs), None
        if not lists.isEmpty():
            for turn in range(len(HUBS) + 1):
                open_ = self._open(lists, links)
                open_ = self.own.put(open_, "open")
                if open_.isEmpty():
                    break
                asked = self._hubs(open_, turn) if turn < len(HUBS) else self._across(open_)
                if tried is not None:
                    asked = asked.join(tried, ["a", "b"], "left_anti")
                asked = self.own.put(asked, "asked")
                tried = asked if tried is None else tried.union(asked)
                links = links.union(self._verified(asked))
        return links

    @staticmethod
    def _posted(groups: DataFrame) -> DataFrame:
        """token, set_id, n, pos: one row for each shingle of a group's prefix."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
                sizes = np.array([len(o) for o in own], dtype=np.int64)
                if not sizes.sum():
                    continue
                row = np.repeat(np.arange(len(own)), sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos)], ["token", "set_id", "n", "pos"])

        return groups.select("set_id", "n", "prefix").mapInArrow(run, "token long, set_id long, n long, pos long")

    def _open(self, lists: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of lists that hold more than one component, with theirs."""
        of = components(links, self.own).select(F.col("node").alias("set_id"), "component")
        small = self.sets.select("set_id", *(F.get("small", i).alias(f"s{i}") for i in range(SKETCH)))
        rows = lists.join(of, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        return rows.join(mixed.select("token"), "token").join(small, "set_id")

    def _hubs(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of a list's hubs and its other members.

        Members are dealt to as many classes as there are hubs in this round, by a hash of the set, and each class's
        least member is a hub, so lists with much the same members have much the same hubs.
        """
        rest = [c for c in rows.columns if c not in ("token", "share", "component")]
        order = F.struct(F.xxhash64("set_id", F.lit(turn)).alias("by"), *rest, "component") if turn else F.struct("component", *rest)
        kind = F.pmod(F.xxhash64("set_id", F.lit(-turn)), F.lit(HUBS[turn]))
        hub = rows.groupBy("token", kind.alias("kind")).agg(F.min(order).alias("hub")).select("token", "hub.*")
        met = rows.alias("a").join(hub.alias("b"), "token").where((F.col("a.component") != F.col("b.component")) & self._near("a", "b") & self._alike())
        return met.select(F.least("a.set_id", "b.set_id").alias("a"), F.greatest("a.set_id", "b.set_id").alias("b")).distinct()

    def _across(self, rows: DataFrame) -> DataFrame:
        """All pairs of a list that lie in different components."""
        return self._met(rows).distinct()

    def _met(self, rows: DataFrame) -> DataFrame:
        """a, b: pairs of different components, where their first common shingle is.

        A row carries up to EARLIER shingles of its set that come before its own.  At the first one that two sets share
        no earlier one is in both, however many are carried: no pair is lost, and one that shares many isn't made at each.
        """
        # A set's rows are its prefix at most.
        first = rows.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "token"))), 1, EARLIER).alias("first"))
        before = F.transform(F.filter("first", lambda x: x["pos"] < F.col("pos")), lambda x: x["token"])
        rows = self.own.put(rows.join(first, "set_id").withColumn("before", before).drop("first"), "carried")
        met = rows.alias("a").join(rows.alias("b"), "token").where((F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.component") != F.col("b.component")) & self._near("a", "b") & self._alike() & ~F.arrays_overlap("a.before", "b.before"))
        return met.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))

    # -- verification

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets reach the similarity."""
        size, num, den = self.size, self.num, self.den

        def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Sets of n and m shingles that link have (n + m) * (den - num) / (den + num) unshared ones at most.
                most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (den - num)
                keep = [differing(x, y) * (den + num) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = list(sets_of(batch.column(2), size))
                right = pa.array([_signature(o) == sig for o, sig in zip(own, batch.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), _binaries(own)], ["set_id", "hashes"]).filter(right)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(den * shared >= num * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        own = self.sets.select("set_id", "n", "odd")
        met = pairs.join(own.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("x")), "a").join(own.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("y")), "b")
        pairs = self.own.put(met.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(tidily(hopeful), "a long, b long"), "hopeful")
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        wanted = self.own.put(self.sets.select("set_id", "doc", "sig").join(ids, "set_id", "left_semi"), "wanted")
        full = self.own.put(_texts_of(self.docs, wanted, *self.cols).mapInArrow(tidily(whole), "set_id long, hashes binary").dropDuplicates(["set_id"]), "whole")
        met = pairs.join(full.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(full.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
        return self.own.put(met.select("a", "b", "x", "y").mapInArrow(tidily(check), "a long, b long"), "links")

    # -- results

    def classes(self) -> DataFrame:
        """doc_id, twin, of (a number of its component), n_shingles, component_id of every document."""
        of = components(self.links(), self.own).select(F.col("node").alias("set_id"), "component")
        sets = self.sets.select("n", "sig", "set_id", "least").join(of, "set_id", "left").select("n", "sig", "least", F.coalesce("component", "set_id").alias("of"))
        sets = self.own.put(sets, "components")
        lowest = sets.groupBy("of").agg(F.min("least").alias("component"))
        sets = sets.join(lowest, "of").select("n", "sig", "of", "component")
        rows = self.documents.select("doc_id", "twin", "n", "sig").join(sets, ["n", "sig"], "left")
        own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
        return rows.select("doc_id", "twin", "of", F.col("n").alias("n_shingles"), own.alias("component_id"))


def jaccard_classes(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * |A & B| >= num * |A | B|."""
    with scratch(docs.sparkSession, "jaccard") as own:
        return own.keep(Join(docs, own, size, num, den, id_col, text_col).classes().drop("twin", "of"), "classes")


def one_of_each(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id, and of several texts under that id the one of the smallest hash.

    Rows without words or an id are alone in their class; of rows with the same id and text one stays.  Rows are told
    apart by id and text (``_twin``), so a repeated id whose texts lie in different classes loses or keeps each by its
    own.  Keys of rows that go are sent to every task if few, joined if not.
    """
    with scratch(docs.sparkSession, "copies") as own:
        found = Join(docs, own, size, num, den, id_col, text_col).classes()
        alone, first = (F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id") == F.col("component_id")
        state = F.when(alone, 2).when(first, 1).otherwise(0)
        rows = own.put(found.groupBy("twin").agg(F.count("*").alias("rows"), F.max(state).alias("state"), F.max("of").alias("of")), "rows")
        best = rows.where("state = 1").groupBy("of").agg(F.min("twin").alias("best"))
        stays = (F.col("state") == 2) | ((F.col("state") == 1) & (F.col("twin") == F.col("best")))
        judged = own.keep(rows.join(best, "of", "left").select("twin", "rows", stays.alias("stays")).where("rows > 1 OR NOT stays"), "judged")
    gone, again = judged.where("NOT stays").select(F.col("twin").alias("_twin")), judged.where("stays").select(F.col("twin").alias("_twin"))

    def met(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(some) if some.count() * KEY_BYTES <= MOST_SENT else some, "_twin", how)

    packed = docs.select(_twin(id_col, text_col).alias("_twin"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    kept = met(packed, gone, "left_anti")
    if again.isEmpty():
        return kept.select("_row.*")
    once = met(kept, again, "left_semi").groupBy("_twin").agg(F.first("_row").alias("_row"))
    return met(kept, again, "left_anti").select("_row.*").union(once.select("_row.*"))
