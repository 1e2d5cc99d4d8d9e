"""Pre-tokens of whole texts, and token ids by distinct piece.

Natural text repeats its words, and a subword tokenizer treats each pre-token on
its own.  So texts are cut into pieces at places where every pre-token boundary is
certain: at white space where the tokenizer drops it, and in byte-level tokenizers
before a run of white space and before the last character of a run that something
follows.  For counts (``Cutter``) each distinct piece of a slice is cut into
pre-tokens by the tokenizer's own normaliser and pre-tokenizer, or, if it is
printable ASCII and the tokenizer's pattern is a known one, by classes of
characters.  For ids (``Encoder``) each distinct piece goes through the library once.

Texts in which such places are not certain (the string of a special token or rare
white space beside other white space in a byte-level tokenizer, and all texts of
tokenizers of other kinds) go through the library whole, so results equal the
library's for every text.  Whole texts and long pieces are never kept.

The memo of pieces is bounded by entries and by bytes; beyond either only those of
the slice at hand stay.  That bounds memory and changes no result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces held in a Python worker, and bytes of their text and ids.
MEMO, MEMO_BYTES = 450_000, 24 << 20
#: Bytes of text handled at once in a Python worker; longer texts stand alone.
SLICE_BYTES = 8 << 20
#: Pieces pre-tokenized in one call, new pieces encoded as one text, bytes of a piece that is not kept.
TOGETHER, JOINED, LONG = 512, 100, 200
#: Pieces gathered at once; small arrays stay in the processor's cache.
GATHER = 40_000
#: White space of every engine, and what is white space for some of them.
PLAIN = " \t\n\v\f\r"
_RARE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ANY = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IS_PLAIN = np.zeros(256, dtype=bool)
_IS_PLAIN[[ord(c) for c in PLAIN]] = True

#: Fixed value: the pattern of a word pre-tokenizer whose meaning for ASCII is known here.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes: a letter, a digit, a mark, and what only the pre-tokenizer knows.
_LETTER, _DIGIT, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte-level vocabularies write a byte as one character: printable Latin-1 as itself, the others from 256 on, in order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = dict(zip((b for b in range(256) if b not in _SELF), range(256, 512), strict=False))
_WRITTEN_SPACE = chr(_WRITTEN[32])


def written(pretoken: str) -> str:
    """A pre-token as byte-level vocabularies write it."""
    if pretoken.isascii() and pretoken.isprintable():
        return pretoken.replace(" ", _WRITTEN_SPACE)
    return pretoken.encode().decode("latin-1").translate(_WRITTEN)


def load(path: str):
    """The tokenizers library's tokenizer for a .json file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gathered(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in record batches of about ``limit`` bytes of column ``text``; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def put() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = start + int(np.searchsorted(np.cumsum(sizes[start:]), limit - size, side="right"))
            stop = max(stop, start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(sizes[start:stop].sum())
            if stop < batch.num_rows or size >= limit:
                yield put()
                held, size = [], 0
            start = stop
    if held:
        yield put()


def runs_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start+length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and each row's offset in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, with the white space before them, and each text's offset among them."""
    raw, offsets = raw_of(texts)
    space = _IS_PLAIN[raw]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    follows = np.zeros(len(raw), dtype=bool)
    follows[:-1] = ~space[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    follows[ends] = False  # nothing follows a run at the end of its text
    cut = begins | (space & follows)
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(at, offsets)


class Cutter:
    """Cuts texts into the pre-tokens of a tokenizer.

    ``kind``: "bytes" for byte-level pre-tokenizers by the usual pattern, "words" for
    vocabularies with word ends, which drop white space, None for all others.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        pre, normal = tokenizer.pre_tokenizer, tokenizer.normalizer
        self.kind, self.easy, self.lower = None, False, False
        if pre is None:
            return
        rules = json.loads(pre.__getstate__())
        if type(pre).__name__ == "ByteLevel" and normal is None and pre.use_regex and not pre.add_prefix_space:
            self.kind = "bytes"
        elif getattr(tokenizer.model, "end_of_word_suffix", None) and [p["type"] for p in rules.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            split, level = rules["pretokenizers"]
            if split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
                self.kind = "words"
                printable = "".join(map(chr, range(33, 127)))
                became = normal.normalize_str(printable) if normal is not None else printable
                self.easy = split["pattern"].get("Regex") == WORD_RULE and became in (printable, printable.lower())
                self.lower = became != printable

    def whole(self, texts: pa.Array) -> np.ndarray:
        """True where a text can't be cut safely."""
        if self.kind is None:
            return np.ones(len(texts), dtype=bool)
        odd = pc.equal(pc.binary_length(texts), -1)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        if self.kind == "bytes":
            odd = pc.or_(odd, pc.match_substring_regex(texts, f"{_RARE}{_ANY}|{_ANY}{_RARE}"))
        return odd.to_numpy(zero_copy_only=False).astype(bool)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, all texts' pre-tokens as indices of them, and each text's offset among those."""
        chunks, offsets = self._chunks(texts)
        coded = chunks.dictionary_encode()
        first, pre = self._pretokens(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(first)[index]
        occurs = pre.indices.to_numpy(zero_copy_only=False)[runs_of(first[index], lengths)]
        return pre.dictionary, occurs, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[offsets]

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and each text's offset among them."""
        if self.kind == "bytes":
            return pieces_of(texts)
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        chunks, offsets = lists.flatten(), offsets - offsets[0]
        full = pc.greater(pc.binary_length(chunks), 0)  # white space at an end leaves empty chunks
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        return chunks.filter(full), before[offsets]

    def _pretokens(self, chunks: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """For each chunk the offset of its pre-tokens (one more than chunks), and the pre-tokens of all chunks."""
        raw, offsets = raw_of(chunks)
        if not self.easy or not len(raw):
            of, found = self._slowly(chunks.to_pylist())
            return np.searchsorted(of, np.arange(len(chunks) + 1)), pa.array(found, pa.string()).dictionary_encode()
        kind = _CLASS[raw]
        mask = np.maximum.reduceat(kind, offsets[:-1]) < _OTHER
        begins = np.ones(len(raw), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[offsets[:-1]] = True
        at = np.flatnonzero(begins)
        of_easy = np.searchsorted(offsets, at, side="right") - 1
        data = np.ascontiguousarray(_LOWER[raw] if self.lower else raw)
        cut = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(data)]).filter(pa.array(mask[of_easy]))
        rest = np.flatnonzero(~mask)
        of, found = self._slowly(chunks.take(pa.array(rest)).to_pylist())
        at = np.concatenate([of_easy[mask[of_easy]], rest[of]])
        order = np.argsort(at, kind="stable")
        tokens = pa.concat_arrays([cut, pa.array(found, pa.string())]).take(pa.array(order))
        return np.searchsorted(at[order], np.arange(len(chunks) + 1)), tokens.dictionary_encode()

    def _slowly(self, chunks: list[str]) -> tuple[np.ndarray, list[str]]:
        """The chunk of each pre-token, and the pre-tokens, by the tokenizer's normaliser and pre-tokenizer."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer is not None else str
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        apart = " " if self.kind == "words" else ""
        # Chunks with white space in front and none behind can stand in one text.
        joins = [self.kind == "words" or (len(c) > 1 and c[0] in PLAIN and not c[1].isspace() and not c[-1].isspace()) for c in chunks]
        of, found = [np.zeros(0, np.int64)], []
        together = [i for i, j in enumerate(joins) if j]
        groups = [together[a : a + TOGETHER] for a in range(0, len(together), TOGETHER)] + [[i] for i, j in enumerate(joins) if not j]
        while groups:
            group = groups.pop()
            text = normal(apart.join(chunks[i] for i in group))
            sizes = [len(p) + 1 for p in text.split(" ")] if apart else [len(chunks[i]) for i in group]
            if len(group) > 1 and len(sizes) != len(group):  # a chunk isn't one word of the normalised text
                groups += [[i] for i in group]
                continue
            got = [g[1] for g in cut(text)]
            which = np.searchsorted(np.cumsum(sizes), np.fromiter((g[0] for g in got), np.int64, len(got)), side="right")
            of.append(np.array(group, dtype=np.int64)[np.minimum(which, len(group) - 1)])
            found += [text[a:b] for a, b in got]
        at = np.concatenate(of)
        order = np.argsort(at, kind="stable")
        return at[order], [found[i] for i in order.tolist()]


class Memo:
    """Distinct piece -> its ids."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        # A byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
        for piece, i in tokenizer.get_vocab().items():
            self.bytes_of[i] = len(piece)
        self.rows: dict[str, int] = {}
        self.counts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.bytes = 0

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each piece begin and how many they are; pieces not met yet are encoded, each once."""
        keys = pieces.to_numpy(zero_copy_only=False).tolist()
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.rows.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        fresh = np.flatnonzero(found < 0)
        lengths, ids = self._encode(pieces.take(pa.array(fresh)), sizes[fresh])
        if len(self.rows) + len(fresh) > MEMO or self.bytes + int(sizes[fresh].sum()) + 4 * (len(self.ids) + len(ids)) > MEMO_BYTES:
            known = np.flatnonzero(found >= 0)  # these alone stay
            old = found[known]
            self.ids = self.ids[runs_of(self.starts[old], self.counts[old])]
            self.counts = self.counts[old]
            self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
            self.rows = dict(zip((keys[i] for i in known.tolist()), range(len(known)), strict=True))
            self.bytes = int(sizes[known].sum())
            found[known] = np.arange(len(known))
        first, used = len(self.counts), len(self.ids)
        # Long pieces come last and are cut off again.
        order = np.argsort(sizes[fresh] >= LONG, kind="stable")
        begin = np.cumsum(lengths, dtype=np.int64) - lengths
        all_ids = np.concatenate([self.ids, ids[runs_of(begin[order], lengths[order])]])
        counts = np.concatenate([self.counts, lengths[order]])
        starts = np.concatenate([self.starts, used + np.cumsum(lengths[order], dtype=np.int64) - lengths[order]])
        found[fresh[order]] = np.arange(first, first + len(fresh))
        kept = first + int((sizes[fresh] < LONG).sum())
        self.rows.update(zip((keys[i] for i in fresh[order][: kept - first].tolist()), range(first, kept), strict=True))
        self.bytes += int(sizes[fresh][sizes[fresh] < LONG].sum())
        self.counts, self.starts = counts[:kept], starts[:kept]
        self.ids = all_ids if kept == len(counts) else all_ids[: starts[kept]].copy()
        return all_ids, starts[found], counts[found]

    def _encode(self, fresh: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids."""
        if not len(fresh):
            return np.zeros(0, np.int32), np.zeros(0, np.uint32)
        encode = self.tokenizer.encode_batch_fast
        # Pieces of one white space and something behind it can stand in one text; the bytes of its ids tell them apart.
        raw, offsets = raw_of(fresh)
        joins = _IS_PLAIN[raw[offsets[:-1]]] & ~_IS_PLAIN[raw[np.minimum(offsets[:-1] + 1, len(raw) - 1)]] & (sizes > 1) & (sizes < LONG)
        joins &= ~pc.match_substring_regex(fresh, _RARE).to_numpy(zero_copy_only=False)
        raw, offsets = raw_of(fresh.filter(pa.array(joins)))
        data, bounds = raw.tobytes(), np.append(offsets[:-1:JOINED], offsets[-1]).tolist()
        texts = [data[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        parts = [np.array(e.ids, dtype=np.uint32) for a in range(0, len(texts), 200) for e in encode(texts[a : a + 200], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        lengths = np.empty(len(fresh), dtype=np.int32)
        lengths[joins] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), offsets[1:], side="left") + 1, prepend=0)
        alone = [e.ids for e in encode(fresh.filter(pa.array(~joins)).to_pylist(), add_special_tokens=False)]
        lengths[~joins] = [len(i) for i in alone]
        out = np.empty(int(lengths.sum()), dtype=np.uint32)
        which = np.repeat(joins, lengths)
        out[which] = ids
        out[~which] = np.fromiter((i for own in alone for i in own), dtype=np.uint32)
        return lengths, out


class Encoder:
    """Ids of whole texts, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.cutter = Cutter(self.tokenizer)
        self.memo = Memo(self.tokenizer) if self.cutter.kind == "bytes" else None

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, ``end`` after each text, and each text's offset (one more than texts)."""
        texts = pc.fill_null(texts, "")
        whole = self.cutter.whole(texts) if self.memo else np.ones(len(texts), dtype=bool)
        cuts = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(texts)]
        parts = [(self._library if whole[a] else self._by_piece)(texts.slice(a, b - a), end) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        if len(parts) == 1:
            return parts[0]
        sizes = np.concatenate([np.diff(starts) for _, starts in parts]) if parts else np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def _library(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        found = [np.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32), np.uint32(end)) for t in texts.to_pylist()]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(f) for f in found])])

    def _by_piece(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        pieces, offsets = pieces_of(texts)
        coded = pieces.dictionary_encode()
        all_ids, places, counts = self.memo.look_up(coded.dictionary)
        occurs = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(counts[occurs], dtype=np.int64)])[offsets] + np.arange(len(offsets))
        out = np.empty(int(starts[-1]), dtype=np.uint32)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GATHER, side="right")) - 1)
            own = occurs[offsets[a] : offsets[b]]
            ids = all_ids[runs_of(places[own], counts[own])]
            # Where a text ends, its end id stands between the ids.
            out[starts[a] : starts[b]] = np.insert(ids, starts[a + 1 : b + 1] - starts[a] - np.arange(1, b - a + 1), end)
            a = b
        return out, starts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder; workers are reused, so its bounded memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
