"""Chat formatting (operator 11).

Method: token-level assembly.  A turn is START role MIDDLE text END.  Roles and
texts are encoded apart from each other, and START, MIDDLE and END are reserved
ids beyond the vocabulary that are spliced between them, so no text can ever be
tokenised into a marker, and no merge runs over one.  The loss mask is +1 where
an assistant's text begins and -1 where it ends, summed over the ids.  Control
strings that occur in a role or text (the markers' own strings and the
tokenizer's special strings) are escaped: a backslash is put behind their first
character, one more if there are some already, so that taking one away again
gives the text back, whatever it held.

Turns are dealt by ranges of (conversation, turn): a conversation that holds a
third of all turns is encoded by many tasks.  What is written are pieces, the
turns of one conversation within a batch; nothing larger is ever a row.

Reading back: a piece that is certainly a whole conversation is decoded where it
is read; those at the edges of batches are brought together by conversation and
streamed in order.  A digest over one conversation is sequential, so that stream
is one task a conversation; it holds one batch and a hash state.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), then role, then text; repeated rows are turns of their own; rows without
a conversation id are one conversation without an id; the columns that come back
are ours, so clashing extra columns can't disturb them; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import encoder, gathered, runs_of
from lodestone.llm.scratch import scratch, tidily

#: conv_id, place (task of the range order, piece in it), certainly a whole conversation, turns, code points of the formatted text, ids as
#: little-endian unsigned 32-bit integers, loss mask as one bit an id.
PIECES = "conv_id long, part int, piece int, whole boolean, n_turns long, formatted_chars long, ids binary, mask binary"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Template:
    """The marker strings, and the roles whose texts are learned."""

    start: str = "[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    learned: tuple[str, ...] = ("assistant",)

    def markers(self) -> tuple[str, str, str]:
        return self.start, self.middle, self.end


def controls(template: Template, special: list[str]) -> list[str]:
    """The strings to be escaped; checked to be such that escapes can't run into each other."""
    found = [*dict.fromkeys([*template.markers(), *special])]
    firsts = {c[0] for c in found if c}
    for c in found:
        if len(c) < 2 or "\\" in c or set(c[1:]) & firsts or any(o != c and o.startswith(c) for o in found):
            raise ValueError(f"{c!r} can't be escaped beside {found}")
    return found


def _families(strings: list[str]) -> list[tuple[str, str, str]]:
    return [(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})", f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})", c) for c in strings]


def escape(texts: pa.Array, strings: list[str]) -> pa.Array:
    """``texts`` with one more backslash in each control string."""
    for longer, _, _ in _families(strings):
        texts = pc.replace_substring_regex(texts, longer, r"\1\\\2\3")
    return texts


def unescape(texts: pa.Array, strings: list[str]) -> pa.Array:
    """The inverse of ``escape``."""
    for _, shorter, _ in _families(strings):
        texts = pc.replace_substring_regex(texts, shorter, r"\1\2\3")
    return texts


def assemble(own, roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' ids, their mask, each turn's offset among them, and each turn's code points, markers included."""
    vocabulary = own.tokenizer.get_vocab_size()
    strings = controls(template, own.cutter.special)
    n = len(texts)
    segments = pc.take(pa.concat_arrays([escape(roles, strings), escape(texts, strings)]), pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
    ids, at = own.ids(segments, vocabulary + 1)  # MIDDLE behind every segment
    ids = ids.copy()
    ids[at[2::2] - 1] = vocabulary + 2  # END behind a text
    ids = np.insert(ids, at[:-1:2], vocabulary)  # START before a role
    begins = at[::2] + np.arange(n + 1)
    learned = pc.is_in(roles, value_set=pa.array(template.learned)).to_numpy(zero_copy_only=False)
    step = np.zeros(len(ids) + 1, dtype=np.int8)
    step[(at[1::2] + np.arange(1, n + 1))[learned]] += 1
    step[(begins[1:] - 1)[learned]] -= 1  # an empty text begins where it ends
    mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    chars = pc.utf8_length(segments).to_numpy().reshape(n, 2).sum(axis=1) + sum(map(len, template.markers()))
    return ids, mask, begins, chars


def format_chats(turns: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """The formatted conversations (PIECES) of a table with conv_id, turn, role and text; it is not written yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, piece = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 2, SLICE_BYTES):
            names, (ids, mask, at, chars) = batch.column(0), assemble(own, batch.column(1), batch.column(2), template)
            cuts = runs(names)
            first = cuts[:-1].tolist()
            bounds = at[cuts].tolist()
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            bits = [np.packbits(mask[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            inside = [0 < i < len(first) - 1 for i in range(len(first))]
            sums = np.add.reduceat(chars, cuts[:-1])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(first, pa.int64())), pa.array([part] * len(first), pa.int32()), pa.array(range(piece, piece + len(first)), pa.int32()), pa.array(inside), pa.array(np.diff(cuts)), pa.array(sums, pa.int64()), pa.array(raw, pa.binary()), pa.array(bits, pa.binary())],
                names=["conv_id", "part", "piece", "whole", "n_turns", "formatted_chars", "ids", "mask"],
            )
            piece += len(first)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").alias("turn"))
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(tidily(run), PIECES)


def runs(names: pa.Array) -> np.ndarray:
    """Where runs of equal values (null equals null) begin, and the length."""
    if not len(names):
        return np.zeros(1, dtype=np.int64)
    if names.null_count:
        values, none = pc.fill_null(names, 0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False)
        changes = (values[1:] != values[:-1]) | (none[1:] != none[:-1])
    else:
        values = names.to_numpy()
        changes = values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changes) + 1, [len(names)]])


def parse(own, raw: list[bytes], bits: list[bytes], template: Template) -> tuple[list[str], list[str], list[str], np.ndarray]:
    """Roles, texts and masked texts of the turns in these pieces, unescaped, and each piece's offset among the turns."""
    vocabulary, strings = own.tokenizer.get_vocab_size(), controls(template, own.cutter.special)
    ids = np.frombuffer(b"".join(raw), "<u4")
    sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    mask = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(bits, sizes, strict=True)]).astype(bool) if raw else np.zeros(0, bool)
    marks = np.flatnonzero(ids >= vocabulary)
    if len(marks) % 3 or (ids[marks].reshape(-1, 3) != vocabulary + np.arange(3)).any():
        raise ValueError("markers are not START, MIDDLE, END by turns")
    begins, middles, ends = marks[::3], marks[1::3], marks[2::3]
    if mask[marks].any():
        raise ValueError("a marker lies under the loss mask")

    def decoded(starts: np.ndarray, stops: np.ndarray, kept: np.ndarray | None = None) -> list[str]:
        lengths = stops - starts
        flat = runs_of(starts, lengths)
        if kept is not None:
            edges = np.concatenate([[0], np.cumsum(kept[flat])])[np.concatenate([[0], np.cumsum(lengths)])]
            flat = flat[kept[flat]]
        else:
            edges = np.concatenate([[0], np.cumsum(lengths)])
        some, edges = ids[flat].tolist(), edges.tolist()
        found = own.tokenizer.decode_batch([some[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], skip_special_tokens=False)
        return unescape(pa.array(found, pa.string()), strings).to_pylist()

    return decoded(begins + 1, middles), decoded(middles + 1, ends), decoded(begins, ends + 1, mask), np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))


class _Digest:
    """What is known of one conversation as its pieces come."""

    def __init__(self, name: int | None):
        self.name, self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = name, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, roles: list[str], texts: list[str], losses: list[str], chars: int) -> None:
        self.turns.update("".join(f"{r}\n{t}\n" for r, t in zip(roles, texts, strict=True)).encode())
        lost = "".join(losses)
        self.loss.update(lost.encode())
        self.n_turns, self.loss_chars, self.chars = self.n_turns + len(roles), self.loss_chars + len(lost), self.chars + chars

    def row(self) -> tuple:
        return self.name, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_chats(pieces: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """One row a conversation (READ), decoded from the ids and masks of a table that ``format_chats`` has made."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in READ.split(", ")]

    def put(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = encoder(tokenizer_path), None
        for batch in gathered(batches, 2, SLICE_BYTES):
            roles, texts, losses, at = parse(own, batch.column(2).to_pylist(), batch.column(3).to_pylist(), template)
            done, at = [], at.tolist()
            for i, (name, chars) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if state is None or state.name != name:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(name)
                part = slice(at[i], at[i + 1])
                state.add(roles[part], texts[part], losses[part], chars)
            yield put(done)
        if state is not None:
            yield put([state.row()])

    columns = ["conv_id", "formatted_chars", "ids", "mask"]
    whole = pieces.where("whole").select(columns)
    edges = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(columns)
    return whole.mapInArrow(tidily(run), READ).union(edges.mapInArrow(tidily(run), READ))


def round_trip(turns: DataFrame, tokenizer_path: str, template: Template = Template()) -> DataFrame:
    """``turns`` formatted, written, and read back from what was written."""
    with scratch(turns.sparkSession, "chats") as own:
        pieces = own.put(format_chats(turns, tokenizer_path, template), "pieces")
        return own.keep(read_chats(pieces, tokenizer_path, template), "read")
