"""Hashed word shingles of whole texts, on Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z folded.
A word's hash is a polynomial of its bytes modulo 2 ** 64, mixed with its length;
a shingle's hash mixes those of its words.  A text with fewer words than a
shingle has is one shingle, a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; small arrays stay in the processor's cache.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, i below n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        steps = [np.full(size, b, dtype=np.uint64) for b in (_BASE, inverse)]
        for s in steps:
            s[0] = 1
        _powers = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of adjacent texts."""
    is_word = _WORD[raw]
    before = np.concatenate([[False], is_word[:-1]])
    after = np.concatenate([is_word[1:], [False]])
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
    hashes = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, of = words(raw, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(of, np.arange(n + 1))
    factors = [np.uint64(pow(0xA24BAED4963EE407, i + 1, 1 << 64)) for i in range(size)]
    whole = max(0, len(hashes) - size + 1)
    rolled = np.zeros(whole, np.uint64)
    for i, f in enumerate(factors):
        rolled += hashes[i : i + whole] * f
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            few = np.full(1, b - a, dtype=np.uint64)
            for i, f in zip(range(a, b), factors, strict=False):
                few += hashes[i : i + 1] * f
            out.append(mixed(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column of texts; null has none."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, side="right")) - 1)
        yield from shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        a = b
