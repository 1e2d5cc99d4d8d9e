"""Packing token streams into windows (operator 4).

Method: Karmarkar-Karp multiway differencing.  Every document's ids (with the
end id) are cut into full windows and a tail; tails are cut into pieces of a
quarter window at most.  Groups of tail pieces, just short of a whole number of
windows, are partitioned: partial partitions are merged largest spread first,
the fullest window of one with the emptiest of the other, until one partition
is left.  If a window exceeds the capacity, the group gets another window and
is partitioned again.  What is left at the end of a task is laid out in full
windows and windows of a power of two, which need no padding.

A task packs its own documents, so nothing is shuffled and memory is bounded by
one slice of text and one group of pieces; what comes back reads a written table.  A task that is run again on the same
split gives the same rows.

Defined results: a null or empty text is the end id alone; every row is its own
document, told apart by ``row_id`` where doc_ids repeat; ties between equal
pieces are broken by their order; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import encoder, gathered
from lodestone.llm.scratch import scratch, tidily

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"
#: Bits of a sequence or row id below its task's number.
TASK_SHIFT = 40


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 .. k-1) of each item by multiway largest differencing.

    A partial partition is a vector of window sums, largest first, less its
    smallest entry once it has k entries.  Memory is O(items * k) at worst.
    """
    n = len(sizes)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[np.ndarray, np.ndarray]] = []  # by joined slot, from n on: the two slots it holds
    slot, fresh = n, n
    while len(heap) > 1:
        (sums_a, slots_a), (sums_b, slots_b) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        if len(sums_a) + len(sums_b) <= k:
            sums, slots = np.concatenate([sums_a, sums_b]), np.concatenate([slots_a, slots_b])
        else:
            sums, slots = np.zeros(k, dtype=np.int64), np.full(k, -1)
            sums[: len(sums_a)], slots[: len(slots_a)] = sums_a, slots_a
            tail, add = slots[k - len(slots_b) :], slots_b[::-1]
            both = np.flatnonzero((tail >= 0) & (add >= 0))
            joined.append((tail[both], add[both]))
            tail[tail < 0] = add[tail < 0]
            tail[both] = np.arange(slot, slot + len(both))
            slot += len(both)
            sums[k - len(sums_b) :] += sums_b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums, slots = sums[order], slots[order]
        if len(sums) == k:
            sums -= sums[-1]
        parts[fresh] = sums, slots
        heapq.heappush(heap, (-int(sums[0]), fresh))
        fresh += 1
    window = np.full(slot, -1, dtype=np.int64)
    if n:
        _, slots = parts[heap[0][1]]
        window[slots[slots >= 0]] = np.flatnonzero(slots >= 0)
    top = slot
    for one, other in reversed(joined):
        own = window[top - len(one) : top]
        window[one], window[other] = own, own
        top -= len(one)
    return window[:n]


def windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows, which rises until none exceeds the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, k)
        if not sizes or np.bincount(found, weights=sizes, minlength=k).max() <= capacity:
            return found, k
        k += 1


class Packer:
    """Packs pieces (row, start, length) of one task; ``rows`` holds what is packed."""

    def __init__(self, capacity: int, group: int, slack: int, first_id: int):
        self.capacity, self.group, self.slack = capacity, group, slack
        self.sequence = first_id
        self.pieces: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.sequence, offset))
            offset += piece[2]
        self.sequence += 1

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        """``doc``: what identifies the document; ids: all of them, the end id too."""
        total, step = len(ids), max(1, self.capacity // 4)
        at = 0
        while total - at >= self.capacity:
            self._put([self._piece(doc, at, ids[at : at + self.capacity])])
            at += self.capacity
        parts = -(-(total - at) // step)
        for i in range(parts):
            size = (total - at) // (parts - i)
            self._hold(doc, at, ids[at : at + size])
            at += size

    @staticmethod
    def _piece(doc: tuple, start: int, ids: np.ndarray) -> tuple:
        return doc, start, len(ids), ids

    def _hold(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        room = self.group * (self.capacity - self.slack) - self.held
        if len(ids) >= room:
            self.pieces.append(self._piece(doc, start, ids[:room]))
            self.held += room
            self._pack()
            start, ids = start + room, ids[room:]
        if len(ids):
            self.pieces.append(self._piece(doc, start, ids))
            self.held += len(ids)

    def _pack(self) -> None:
        found, k = windows([p[2] for p in self.pieces], self.capacity)
        by: list[list[tuple]] = [[] for _ in range(k)]
        for piece, w in zip(self.pieces, found.tolist(), strict=True):
            by[w].append(piece)
        for own in by:
            if own:
                self._put(own)
        self.pieces, self.held = [], 0

    def finish(self) -> None:
        """The last group: near-equal windows, and the rest without padding."""
        full = self.held // self.capacity
        rest = self.held - full * (self.capacity - self.slack)
        sizes = []
        while rest > 0:
            sizes.append(self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1))
            rest -= sizes[-1]
        for size in sizes:
            own = []
            while size:
                doc, start, length, ids = self.pieces.pop()
                take = min(size, length)
                if take < length:
                    self.pieces.append(self._piece(doc, start, ids[: length - take]))
                own.append(self._piece(doc, start + length - take, ids[length - take :]))
                self.held -= take
                size -= take
            self._put(own)
        if self.pieces:
            self._pack()

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [[r[0][0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(np.ascontiguousarray(r[3], dtype="<u4")) for r in rows], [r[0][1] for r in rows], [r[4] for r in rows], [r[5] for r in rows], [r[0][2] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, group: int = 128, slack: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents' ids, packed into sequences of at most ``capacity``.

    ``group``: windows partitioned at a time; ``slack``: ids a window that a group
    leaves free, so that near-equal windows fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << TASK_SHIFT
        packer, row = Packer(capacity, group, slack, base), base
        for batch in gathered(batches, 1):
            names = batch.column(0).to_pylist()
            ids, at = own.ids(batch.column(1), end_id)
            at = at.tolist()
            for i, name in enumerate(names):
                packer.add((name, at[i + 1] - at[i], row), ids[at[i] : at[i + 1]])
                row += 1
            if packer.rows:
                yield packer.flush()
        packer.finish()
        if packer.rows:
            yield packer.flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession, "packing") as own:
        return own.keep(rows.mapInArrow(tidily(run), SCHEMA), "pieces")
