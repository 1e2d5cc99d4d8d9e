"""Token ids as length-limited canonical Huffman blocks (operator 6).

Method: ids are counted over the whole corpus as it is tokenised, the package-merge algorithm gives
code lengths of at most LIMIT bits, and canonical codes follow from the lengths
alone.  Documents are written in ascending doc_id order as independent blocks;
each block holds its bit stream and the bit offset of every SEGMENT ids
(checkpoints), from which many segments are decoded side by side by table
lookup.

Layout: ``<path>/codebook`` has (id, bits); ``<path>/blocks`` has one row per
block: part, block, first (ids before it in the part), n_docs, n_ids, body.
Parquet is the container, so that Spark's commit protocol publishes whole files
only and any store can hold them; ``body`` is the format of ``write_block``.

The driver holds one number per id of the vocabulary and one per part.

Defined results: a null or empty text is the end id alone; rows that repeat a
doc_id are written in the order of their length and stream; a null doc_id
comes first; an empty table gives no blocks; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chunks import encoder, gathered
from lodestone.llm.scratch import Scratch, scratch, scratch_path, tidily

#: Longest code in bits, while the ids in use are at most 2 ** LIMIT.
LIMIT = 16
#: Ids from one checkpoint to the next.
SEGMENT = 512
#: Ids of a block, at least; a document is never split over blocks.
BLOCK_IDS = 1 << 20
#: Ids encoded at once; small arrays stay in the processor's cache.
ENCODE_IDS = 1 << 17
#: Ids of a part (a file) on average.
PART_IDS = 16 << 20
MAGIC = b"LHB1"


# --- the code -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, flags = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        flags.append(rank < n)
        level = both[rank]
    need, bits = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for flag in reversed(flags):
        taken = int(flag[:need].sum())
        bits[:taken] += 1
        need = 2 * (need - taken)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Code of each id: ascending by length, then by id."""
    codes = np.zeros(len(bits), dtype=np.uint64)
    used = np.flatnonzero(bits)
    used = used[np.argsort(bits[used], kind="stable")]
    code = last = 0
    for i, b in zip(used.tolist(), bits[used].tolist(), strict=True):
        code <<= b - last
        codes[i], last = code, b
        code += 1
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for every value of the next ``width`` bits."""
    used = np.flatnonzero(bits)
    width = int(bits.max()) if len(used) else 1
    used = used[np.argsort(bits[used], kind="stable")]
    spans = 1 << (width - bits[used].astype(np.int64))
    ids, sizes = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    total = int(spans.sum())
    ids[:total], sizes[:total] = np.repeat(used, spans), np.repeat(bits[used], spans)
    return ids, sizes, width


def pack_bits(codes: np.ndarray, bits: np.ndarray, offsets: np.ndarray, total_bits: int) -> bytes:
    """The codes at their bit offsets, most significant bit first."""
    words = np.zeros(total_bits // 64 + 2, dtype=np.uint64)
    if len(codes):
        word, inside = offsets >> 6, offsets & 63
        left = 64 - inside - bits
        over = left < 0
        main = np.where(over, codes >> np.where(over, -left, 0).astype(np.uint64), codes << np.where(over, 0, left).astype(np.uint64))
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[starts]] = np.bitwise_or.reduceat(main, starts)
        words[word[over] + 1] |= codes[over] << (64 + left[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total_bits + 7) // 8]


def encode_docs(ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Each document's stream from a byte of its own on.

    Gives all streams, each document's first byte (one more than documents), the
    bit offsets of all checkpoints, counted from its document's first byte, and
    each document's first checkpoint (one more than documents).
    """
    sizes = bits[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    doc_bits = ends[starts[1:]] - ends[starts[:-1]]
    at = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])
    n = np.diff(starts)
    inside = ends[:-1] - np.repeat(ends[starts[:-1]], n)
    stream = pack_bits(codes[ids], sizes, inside + np.repeat(at[:-1] * 8, n), int(at[-1]) * 8)
    nth = np.arange(len(ids)) - np.repeat(starts[:-1], n)
    return stream, at, inside[nth % SEGMENT == 0], np.concatenate([[0], np.cumsum(-(-n // SEGMENT))])


# --- blocks -------------------------------------------------------------------


def write_block(doc_ids: list, sizes: list[int], streams: list[bytes], checkpoints: list[bytes]) -> bytes:
    """MAGIC, crc32 of the rest, documents, bytes of stream, then arrays: doc ids and whether null, ids, stream bytes, checkpoints, streams."""
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    rest = b"".join([
        struct.pack("<IQ", len(doc_ids), sum(map(len, streams))),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(),
        np.array(sizes, dtype="<u4").tobytes(), np.array([len(s) for s in streams], dtype="<u4").tobytes(), *checkpoints, *streams,
    ])
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def read_block(body: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, ids of each document, all ids.  A damaged block raises ValueError."""
    if body[:4] != MAGIC or struct.unpack_from("<I", body, 4)[0] != zlib.crc32(memoryview(body)[8:]):
        raise ValueError("damaged block")
    n, size = struct.unpack_from("<IQ", body, 8)
    at = 20
    names = np.frombuffer(body, "<i8", n, at)
    known = np.frombuffer(body, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(body, "<u4", n, at + 9 * n).astype(np.int64)
    lengths = np.frombuffer(body, "<u4", n, at + 13 * n).astype(np.int64)
    segments = -(-sizes // SEGMENT)
    at += 17 * n
    marks = np.frombuffer(body, "<u4", int(segments.sum()), at).astype(np.int64)
    stream = np.frombuffer(body, np.uint8, size, at + 4 * len(marks))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    lane_bits = marks + np.repeat(first * 8, segments)
    nth = np.arange(len(marks)) - np.repeat(np.cumsum(segments) - segments, segments)
    lane_ids = np.minimum(SEGMENT, np.repeat(sizes, segments) - nth * SEGMENT)
    ids = decode_lanes(stream, lane_bits, lane_ids, table)
    return [int(d) if k else None for d, k in zip(names.tolist(), known.tolist(), strict=True)], sizes, ids


def decode_lanes(stream: np.ndarray, at: np.ndarray, lengths: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All lanes' ids, one after the other; the lanes advance side by side."""
    ids, sizes, width = table
    padded = np.concatenate([stream, np.zeros(8, np.uint8)]).astype(np.uint32)
    peek = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(begin[-1]), dtype=np.uint32)
    order = np.argsort(-lengths, kind="stable")
    at, begin = at[order].copy(), begin[:-1][order]
    ends = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
    mask = np.uint32((1 << width) - 1)
    for step, live in enumerate(ends.tolist()):
        now = at[:live]
        key = (peek[now >> 3] >> (32 - width - (now & 7)).astype(np.uint32)) & mask
        out[begin[:live] + step] = ids[key]
        now += sizes[key]
    return out


# --- Spark --------------------------------------------------------------------


def _ids_of(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (binary, of type ``kind``), and at the end of each task a row with the task's counts (used: ids, n: how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        total = np.zeros(max(own.tokenizer.get_vocab_size(), end_id + 1), dtype=np.int64)
        for batch in gathered(batches, 1):
            ids, at = own.ids(batch.column(1), end_id)
            total += np.bincount(ids, minlength=len(total))
            data = ids.astype(kind)
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * data.itemsize).astype("<i4")), pa.py_buffer(data)])
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), blob, none, none], ["doc_id", "ids", "used", "n"])
        used = np.flatnonzero(total)
        columns = [pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([used], pa.list_(pa.int64())), pa.array([total[used]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "used", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidily(run), "doc_id long, ids binary, used array<long>, n array<long>")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and each row's offset."""
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4", count=len(column) + 1, offset=4 * column.offset).astype(np.int64)
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, dtype=kind, count=int(offsets[-1] - offsets[0]) // size, offset=int(offsets[0])) if data and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return ids.astype(np.int64), (offsets - offsets[0]) // size


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents' ids below ``path``."""
    with scratch(docs.sparkSession, "huffman") as own:
        _write(docs, own, path, tokenizer_path, end_id, id_col, text_col)


def _write(docs: DataFrame, own: Scratch, path: str, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> None:
    spark = docs.sparkSession
    vocabulary = encoder(tokenizer_path).tokenizer.get_vocab_size()
    kind = _kind(max(vocabulary, end_id + 1))
    made = own.put(_ids_of(docs, tokenizer_path, end_id, kind, id_col, text_col), "ids")
    held = made.where(F.col("ids").isNotNull()).select("doc_id", "ids")
    # At most one row per id of the vocabulary comes to the driver.
    counts = np.zeros(max(vocabulary, end_id + 1), dtype=np.int64)
    told = made.where(F.col("used").isNotNull()).select(F.inline(F.arrays_zip("used", "n"))).groupBy("used").agg(F.sum("n").alias("n")).toArrow()
    counts[told.column("used").to_numpy()] = told.column("n").to_numpy()
    bits = code_lengths(counts)
    used = np.flatnonzero(bits)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(bits[used].astype(np.int32))})).coalesce(1).write.parquet(f"{path}/codebook")

    parts = max(1, -(-int(counts.sum()) // PART_IDS))
    cuts = held.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()["cuts"] if parts > 1 else []
    shared = spark.sparkContext.broadcast((bits, canonical_codes(bits), np.array(cuts or [], dtype=np.int64)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes, cuts = shared.value
        for batch in batches:
            blobs = batch.column(1)
            step = max(1, len(blobs) * ENCODE_IDS // max(1, blobs.nbytes // 2))
            for start in range(0, len(blobs), step):
                own = blobs.slice(start, step)
                names = batch.column(0).slice(start, step)
                ids, at = _flat(own, kind)
                stream, ends, marks, first = encode_docs(ids, at, codes, bits)
                part = np.searchsorted(cuts, names.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
                marks = marks.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(part), names, pa.array(np.diff(at)),
                    pa.array([marks[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                    pa.array([stream[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
                ], ["part", "doc_id", "n", "marks", "stream"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, streams, marks = [], [], [], []
        nth = first = n = 0

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (nth, pa.int32()), (first, pa.int64()), (len(names), pa.int32()), (n, pa.int64()), (write_block(names, sizes, streams, marks), pa.binary()))], ["part", "block", "first", "n_docs", "n_ids", "body"])

        part = TaskContext.get().partitionId()
        for batch in batches:
            for name, size, mark, stream in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                names.append(name), sizes.append(size), streams.append(stream), marks.append(mark)
                n += size
                if n >= BLOCK_IDS:
                    yield put()
                    nth, first, n = nth + 1, first + n, 0
                    names, sizes, streams, marks = [], [], [], []
        if names:
            yield put()

    rows = held.mapInArrow(tidily(encode), "part int, doc_id long, n long, marks binary, stream binary")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "n", "stream")
    rows.mapInArrow(tidily(block), "part int, block int, first long, n_docs int, n_ids long, body binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian) in the order written; one row per document."""
    return _decoded(spark, path, digest=False)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ids_crc32 instead of the ids."""
    return _decoded(spark, path, digest=True)


def _decoded(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # a row per id of the vocabulary at most
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.uint8)
    bits[book["id"].to_numpy()] = book["bits"].to_numpy()
    # A row per part: ids before it.
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(totals):
        before[part], total = total, total + totals[part]
    shared = spark.sparkContext.broadcast((bits, before))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, before = shared.value
        table = decode_table(bits)
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, body = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                names, sizes, ids = read_block(body, table)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                data = ids.astype("<u4", copy=False)
                if digest:
                    what = pa.array([zlib.crc32(data[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64())
                else:
                    what = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((starts * 4).astype("<i4")), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts[:-1] + (before[part] + first)), pa.array(sizes), what], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.select("part", "first", "body").mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write all documents' ids to the shared folder, read the files back and return their digests."""
    path = scratch_path(docs.sparkSession, "huffman")
    write(docs, path, tokenizer_path, end_id)
    return digests(docs.sparkSession, path)
