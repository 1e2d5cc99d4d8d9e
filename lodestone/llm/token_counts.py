"""Token counts (operator 1).

Method: texts are cut into the tokenizer's pre-tokens (``chunks``).  Every slice
of texts (about SLICE_BYTES) is one block: its distinct pre-tokens, and for each
document how often it has which of them.  The blocks' distinct pre-tokens are
brought together by pre-token, and each is counted once by the tokenizer's model;
the counts are joined to the blocks' frequencies, and a document's tokens are the
sum of frequency times count.  No token ids are made.

What is shuffled is a block's distinct pre-tokens and its packed frequencies, not
words.  However common, a pre-token is one row for each block (20 MB of text); a
block is bounded by its slice of text.

Where chunks can't be pre-tokenized by themselves (a tokenizer that is neither
byte-level nor has word ends, and in byte-level ones texts that hold a special
string or rare white space beside other white space), a text is counted whole by
the library, and its number stands in its block.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
give repeated rows; a null id is kept; the columns that come back are ours, so
clashing extra columns of the input can't disturb them; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import Encoder, encoder, gathered, written
from lodestone.llm.scratch import scratch, tidily

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of text of a block.
SLICE_BYTES = 20 << 20
#: Bits of a block's number below its task's.
TASK_SHIFT = 32


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as four planes of bytes, which compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def frequencies(own: Encoder, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, number of pairs of each text, the pairs' pre-token and count, and tokens counted apart."""
    texts = pc.fill_null(texts, "")
    cutter = own.cutter
    apart = np.zeros(len(texts), dtype=np.int64)
    if cutter.kind == "words":  # a special string is one token and parts what is around it, as white space does
        for content in cutter.special:
            apart += pc.count_substring(texts, content).to_numpy()
            texts = pc.replace_substring(texts, content, " ")
    else:
        whole = cutter.whole(texts)
        for i in np.flatnonzero(whole).tolist():
            apart[i] = len(own.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        texts = pc.if_else(pa.array(whole), "", texts)
    words, occurs, offsets = cutter.cut(texts)
    size = max(1, len(words))
    order = pc.sort_indices(words).to_numpy()  # neighbours in the alphabet compress well
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    key = np.repeat(np.arange(len(texts)) * size, np.diff(offsets)) + rank[occurs]
    key.sort()
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    counts, key = np.diff(np.append(at, len(key))), key[at]
    return words.take(pa.array(order)), np.bincount(key // size, minlength=len(texts)), key % size, counts, apart


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    ``tokenizer_path``: a .json file of the tokenizers library, on every executor.
    """

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for nth, batch in enumerate(gathered(batches, 1, SLICE_BYTES)):
            words, pairs, which, counts, apart = frequencies(own, batch.column(1))
            first = np.concatenate([[0], np.cumsum(pairs)])[:-1]
            delta = np.diff(which, prepend=0)
            opens = first[pairs > 0]
            delta[opens] = which[opens]
            columns = [
                pa.array([(TaskContext.get().partitionId() << TASK_SHIFT) + nth], pa.int64()),
                pa.ListArray.from_arrays([0, len(words)], words),
                pa.array([batch.column(0)], pa.list_(pa.int64())),
                pa.array([pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())], pa.list_(pa.int64())),
                pa.array([apart], pa.list_(pa.int64())),
                *(pa.array([planes(x)], pa.binary()) for x in (pairs, delta, counts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "words", "ids", "sizes", "apart", "pairs", "delta", "counts"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of the pre-token, so each is counted once, also where its rows go on in the next batch."""
        model = encoder(tokenizer_path).tokenizer.model
        last, worth = None, 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            n = [worth if w == last else len(model.tokenize(written(w))) for w in words]
            if words:
                last, worth = words[-1], n[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()).take(coded.indices)], ["block", "place", "n"])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        worth = np.zeros(left.num_rows, dtype=np.int64)
        worth[left.column("place").to_numpy()] = left.column("n").to_numpy()
        parts = []
        for row in right.to_pylist():
            pairs, delta, counts = (from_planes(row[c]) for c in ("pairs", "delta", "counts"))
            ends = np.concatenate([[0], np.cumsum(pairs)])
            which = np.cumsum(delta)
            first = ends[:-1][pairs > 0]
            which -= np.repeat(which[first] - delta[first], pairs[pairs > 0])
            total = np.concatenate([[0], np.cumsum(counts * worth[which])])
            n = total[ends[1:]] - total[ends[:-1]] + np.array(row["apart"], dtype=np.int64)
            parts.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]))
        return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "over_limit": pa.array([], pa.bool_())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession, "tokens") as own:
        kinds = "block long, words array<string>, ids array<long>, sizes array<long>, apart array<long>, pairs binary, delta binary, counts binary"
        blocks = own.put(rows.mapInArrow(tidily(to_blocks), kinds), "blocks")
        places = blocks.select("block", F.posexplode("words").alias("place", "word"))
        # One shuffle brings the rows of a pre-token together, a row for each block that has it.
        met = places.repartition("word").sortWithinPartitions("word").mapInArrow(tidily(pieces), "block long, place int, n int")
        packed = blocks.select(F.col("block").alias("own"), "ids", "sizes", "apart", "pairs", "delta", "counts")
        return own.keep(met.groupBy("block").cogroup(packed.groupBy("own")).applyInArrow(summed, SCHEMA), "counts")
