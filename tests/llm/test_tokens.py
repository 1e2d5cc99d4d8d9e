import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestone.llm import huffman, packing  # noqa: E402
from lodestone.llm.chunks import Encoder  # noqa: E402
from lodestone.llm.packing import Packer, differencing, pack, windows  # noqa: E402
from lodestone.llm.scratch import scratch_path  # noqa: E402
from lodestone.llm.token_counts import token_counts  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoders():
    return {p: Encoder(p) for p in (BYTES, WORDS)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.'aAsté  \x1c<|>"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_ids_equal_the_library(encoders, texts):
    for e in encoders.values():
        ids, at = e.ids(pa.array(texts, pa.string()), 2)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_the_memo_is_cut_back(monkeypatch):
    from lodestone.llm import chunks

    monkeypatch.setattr(chunks, "MEMO", 3)
    e = Encoder(BYTES)
    texts = ["one two three four five six", "seven eight one two <|endoftext|>", None]
    for t in (texts, list(reversed(texts)), texts[:1]):
        ids, at = e.ids(pa.array(t, pa.string()), 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*e.tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for x in t]


def test_the_memo_holds_no_whole_texts(monkeypatch):
    """Blank lines, double spaces, special strings and words without end leave a memo of short pieces, bounded in bytes."""
    from lodestone.llm import chunks

    monkeypatch.setattr(chunks, "MEMO_BYTES", 1 << 16)
    e = Encoder(BYTES)
    words = [f"w{i % 97}x{i * 7919 % 1009}" for i in range(40_000)]
    texts = [" ".join(words[i : i + 40]) + "\n\n" + "  ".join(words[i + 40 : i + 80]) + ("<|endoftext|>" if i % 400 == 0 else "") for i in range(0, 40_000, 80)]
    texts += ["y" * 50_000, "z " * 2000 + "\t\t", " \n" * 300]
    for start in range(0, len(texts), 50):
        own = texts[start : start + 50]
        ids, at = e.ids(pa.array(own), 2)
        assert all(len(p.encode()) < chunks.LONG for p in e.memo.rows)
        assert sum(map(len, e.memo.rows)) + 4 * len(e.memo.ids) <= (1 << 16) + sum(map(len, own))
        for i, t in enumerate(own):
            assert ids[at[i] : at[i + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_batches_are_gathered_by_bytes():
    from lodestone.llm.chunks import gathered

    texts = ["a" * 10, None, "b" * 100, "c" * 30, "d" * 30, "", "e" * 5]
    batches = pa.Table.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"]).to_batches(max_chunksize=3)
    out = list(gathered(iter(batches), 1, 64))
    assert [x for b in out for x in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= 64 for b in out)


def test_counts(messy, nothing, encoders):
    rows = token_counts(messy, WORDS, limit=10).collect()
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    assert len(rows) == messy.count()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        n = len(encoders[WORDS].tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 10)
    assert token_counts(nothing, WORDS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=60))
def test_differencing_places_every_item(sizes):
    found, k = windows(sizes, 512)
    assert len(found) == len(sizes) and (not sizes or (found.min() >= 0 and found.max() < k))
    assert np.bincount(found, weights=sizes, minlength=k).max(initial=0) <= 512


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 500, 600).tolist()
    sums = np.bincount(differencing(sizes, 40), weights=sizes, minlength=40)
    assert sums.max() - sums.min() < 60


def test_window_count_rises():
    assert windows([300, 300, 300], 512)[1] == 3


def test_packer_covers_all_and_pads_little():
    rng = np.random.default_rng(2)
    lengths = (np.exp(rng.normal(6.4, 1.1, 1500)).astype(int) + 1).tolist()
    p = Packer(2048, 128, 12, 0)
    for i, n in enumerate(lengths):
        p.add((i, n, i), np.arange(n, dtype=np.uint32))
    p.finish()
    d = p.flush().to_pandas()
    assert d.groupby("doc_id")["length"].sum().to_dict() == dict(enumerate(lengths))
    fill = d.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill)
    assert fill.max() <= 2048 and padding < 0.012 * sum(lengths)


def test_packing(messy, nothing, encoders):
    rows = pack(messy, BYTES).collect()
    ids = {r["doc_id"]: np.array([*encoders[BYTES].tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in messy.collect()}
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        by_row[r["row_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert len(by_row) == messy.count()
    for key, of in ((("start"), by_row), (("offset"), by_sequence)):
        for own in of.values():
            at = 0
            for r in sorted(own, key=lambda r: r[key]):
                assert r[key] == at
                at += r["length"]
    assert all(sum(r["length"] for r in own) <= 2048 for own in by_sequence.values())
    assert pack(nothing, BYTES).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=40), min_size=1, max_size=8), st.integers(9, 16))
def test_block_round_trip(docs, limit):
    ids = np.array([i for d in docs for i in d])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    counts = np.bincount(ids, minlength=301)
    bits = huffman.code_lengths(counts, limit)
    assert bits.max() <= limit and (bits[counts > 0] > 0).all() and sum(2.0 ** -int(b) for b in bits[bits > 0]) <= 1
    stream, at, marks, first = huffman.encode_docs(ids, starts, huffman.canonical_codes(bits), bits)
    marks = marks.astype("<u4")
    body = huffman.write_block([None, *range(1, len(docs))], [len(d) for d in docs], [stream[a:b] for a, b in zip(at[:-1], at[1:])], [marks[a:b].tobytes() for a, b in zip(first[:-1], first[1:])])
    names, sizes, out = huffman.read_block(body, huffman.decode_table(bits))
    assert names[0] is None and sizes.tolist() == [len(d) for d in docs] and out.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        huffman.read_block(body[:-1] + bytes([body[-1] ^ 1]), huffman.decode_table(bits))


def test_package_merge_is_huffman_without_a_limit():
    import heapq

    for seed in range(5):
        counts = np.random.default_rng(seed).integers(1, 1000, 40)
        heap, cost = sorted(counts.tolist()), 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((counts * huffman.code_lengths(counts, 32)).sum()) == cost


@pytest.mark.parametrize("part_ids", [1 << 24, 4000])
def test_huffman_files(spark, messy, nothing, encoders, monkeypatch, part_ids):
    monkeypatch.setattr(huffman, "PART_IDS", part_ids)
    rows = huffman.round_trip(messy, BYTES, 2).collect()
    ids = {r["doc_id"]: np.array([*encoders[BYTES].tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in messy.collect()}
    assert len(rows) == messy.count()
    at, last = 0, None
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]].tobytes())
        assert last is None or r["doc_id"] >= last
        at, last = at + r["n_tokens"], r["doc_id"]
    assert huffman.round_trip(nothing, BYTES, 2).count() == 0


def test_huffman_ids_are_read_back(spark, messy, encoders):
    path = scratch_path(spark, "test")
    huffman.write(messy.where("doc_id = 12"), path, BYTES, 2)
    got = huffman.read(spark, path).first()
    assert np.frombuffer(got["ids"], "<u4").tolist() == [*encoders[BYTES].tokenizer.encode(messy.where("doc_id = 12").first()["text"], add_special_tokens=False).ids, 2]


def test_packer_uses_powers_of_two_at_the_end():
    p = packing.Packer(2048, 128, 12, 0)
    p.add((1, 1300, 0), np.arange(1300, dtype=np.uint32))
    p.finish()
    fill = p.flush().to_pandas().groupby("sequence_id")["length"].sum()
    assert all(n & (n - 1) == 0 for n in fill) and fill.sum() == 1300
