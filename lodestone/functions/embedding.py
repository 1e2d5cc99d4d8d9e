"""A hashing embedder: the stand-in for a model, in one Arrow pass.

A text is cut into chunks, every chunk's tokens are hashed and counted with a sign in
one array for a whole batch, and the chunks' vectors are averaged by text and brought
to length 1.  Nothing is done text by text but finding where its chunks end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.chunking import CHARS, pieces

#: The hash of a token: its lower-cased bytes as digits of an odd base modulo 2 ** 64, mixed.
BASE = 0x9E3779B97F4A7C15
#: Chunks that are hashed at once, and bytes of the texts that are cut at once.
CHUNKS, RUN = 256, 2_000_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 95]] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_bounds(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the identifiers and numbers in ``raw``; none runs over a place in ``cuts``.

    A run of letters, digits and underscores is one identifier, or its leading digits a number and the rest one.
    """
    kind = _KIND[raw]
    word = kind > 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inner] |= word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts
    run = np.cumsum(first) - 1
    letters = np.flatnonzero(kind == 1)
    lead = np.full(len(starts), len(raw), dtype=np.int64)  # the first that is no digit
    np.minimum.at(lead, run[letters], letters)
    ends = np.append(starts[1:], len(raw))
    last = np.flatnonzero(word)
    stop = np.zeros(len(starts), dtype=np.int64)
    np.maximum.at(stop, run[last], last + 1)
    ends = np.minimum(ends, stop)
    split = (lead > starts) & (lead < ends)
    begins = np.concatenate([starts, lead[split]])
    finish = np.concatenate([np.where(split, lead, ends), ends[split]])
    order = np.argsort(begins, kind="stable")
    return begins[order], finish[order]


def token_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each token, letters lower-cased: differences of running sums, so no token is cut out."""
    with np.errstate(over="ignore"):
        powers = np.ones(len(raw) + 1, dtype=np.uint64)
        powers[1:] = np.cumprod(np.full(len(raw), BASE, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        back = np.ones(len(raw) + 1, dtype=np.uint64)
        back[1:] = np.cumprod(np.full(len(raw), inverse, dtype=np.uint64))
        h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * _MIX
        return h ^ (h >> np.uint64(31))


def chunk_vectors(chunks: pa.Array, dimensions: int) -> np.ndarray:
    """Signed counts of each chunk's hashed tokens at length 1, a row a chunk; zeros for one without tokens."""
    n = len(chunks)
    offsets = np.frombuffer(chunks.buffers()[1], np.int32, n + 1, 4 * chunks.offset).astype(np.int64) if n else np.zeros(1, np.int64)
    data = chunks.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends = token_bounds(raw, offsets)
    hashes = token_hashes(raw, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    flat = np.bincount(row * dimensions + (hashes % np.uint64(dimensions)).astype(np.int64), weights=sign, minlength=n * dimensions)
    return unit(flat.astype(np.float64).reshape(n, dimensions))  # counts of nothing are whole numbers


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def embedded(texts: pa.Array, dimensions: int, size: int, overlap: int, model: Callable[[pa.Array, int], np.ndarray] = chunk_vectors) -> np.ndarray:
    """A vector of each text: the mean of its chunks' at length 1; zeros for a null or empty text.  ``model`` embeds a batch of chunks."""
    listed = pieces(texts, size, overlap)
    counts = np.diff(np.frombuffer(listed.buffers()[1], np.int32, len(listed) + 1)).astype(np.int64) if len(listed) else np.zeros(0, np.int64)
    flat = listed.flatten()
    # A run of chunks at a time: a token's hash takes several numbers for each byte.
    vectors = np.concatenate([model(flat.slice(a, CHUNKS), dimensions) for a in range(0, len(flat), CHUNKS)] or [np.zeros((0, dimensions))])
    out = np.zeros((len(texts), dimensions))
    some = counts > 0
    if some.any():
        heads = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(vectors, heads, axis=0) / counts[some, None]
    return unit(out)


def runs(texts: pa.Array) -> list[pa.Array]:
    """A batch in runs of about RUN bytes, a text at least: what a task holds doesn't grow with the batch's texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // RUN)) + 1 if len(size) else np.zeros(0, np.int64)
    bounds = [0, *cuts.tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def embedder(dimensions: int = 768, max_tokens: int = 450, overlap: int = 50, model: Callable[[pa.Array, int], np.ndarray] = chunk_vectors) -> Callable[[Column | str], Column]:
    """From a text column to its vectors: chunked, embedded and pooled in one pass over Arrow batches."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        found = np.concatenate([embedded(t, dimensions, CHARS * max_tokens, CHARS * overlap, model).astype(np.float32) for t in runs(texts)] or [np.zeros((0, dimensions), np.float32)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimensions), pa.array(found.ravel()))

    return embed
