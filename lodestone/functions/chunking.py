"""A text's chunks in time linear in its length.

The places of line feeds are found once for each text; chunks are then walked over
numbers, and a chunk's text is cut out of the bytes at once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token.
CHARS = 4


def walk(length: int, feeds: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk of a text of ``length`` with line feeds at ``feeds`` (ascending).

    A chunk holds at most ``size`` characters and ends before the last line feed in
    reach, if that isn't its first character.  The next one begins ``overlap``
    characters before that end or, if that is no progress, at the end.
    """
    out, start, feeds = [], 0, feeds.tolist()
    while start < length:
        end = min(start + size, length)
        if end < length and (at := bisect_left(feeds, end)) and feeds[at - 1] > start:
            end = feeds[at - 1]
        out.append((start, end))
        start = length if end >= length else end - overlap if end - overlap > start else end
    return out


def _of(text: str | None, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray | None, list[tuple[int, int]]]:
    """The bytes, where characters begin in them (null: one byte each), and the spans."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if text is None or len(raw) == len(text):
        return raw, None, walk(len(raw), np.flatnonzero(raw == 10), size, overlap)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    return raw, begins, walk(len(begins), np.flatnonzero(raw[begins] == 10), size, overlap)


def spans(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """array<struct<start, end>> in characters, for a column of texts."""
    counts, flat = [0], []
    for text in texts:
        flat += _of(text.as_py(), size, overlap)[2]
        counts.append(len(flat))
    both = np.array(flat, dtype=np.int32).reshape(-1, 2)
    own = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), own)


def pieces(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """array<string>: the chunks of a column of texts."""
    out = []
    for text in texts:
        raw, begins, found = _of(text.as_py(), size, overlap)
        places = np.array(found, dtype=np.int64).reshape(-1, 2)
        if begins is not None:
            places = np.append(begins, len(raw))[places]
        data = raw.tobytes()
        out.append([data[a:b].decode() for a, b in places.tolist()])
    return pa.array(out, pa.list_(pa.string()))


def chunk_spans(text: Column, size: int, overlap: int) -> Column:
    """Start and end (from 0, end exclusive) of a text's chunks; none for a null or empty text."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def found(texts: pa.Array) -> pa.Array:
        return spans(texts, size, overlap)

    return found(text)


def chunks(text: Column, max_tokens: int = 450, overlap: int = 50) -> Column:
    """A text's chunks; none for a null or empty text."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pieces(texts, CHARS * max_tokens, CHARS * overlap)

    return found(text)
