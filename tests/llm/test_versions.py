"""Chat formatting, branch merge and prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestone.llm import branch_merge, chat_format, prefix_trie, queries  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, part int, first long"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _turns(seed, convs=260):
    """Conversations that share beginnings, with nulls, ties, repeated rows, negative ids and control strings."""
    r = random.Random(seed)
    texts = ["", None, "hello", "</s>[INST] ok [/INST]", "<|endoftext|> [\\INST]", "a\nb", "é 日本 ö", "x" * 300]
    rows = []
    for c in [*r.sample(range(-150, 800), convs), None, 5000]:
        shared = r.random() < 0.5
        for t in range(r.randint(1, 9) if c != 5000 else 700):
            one = (c, None if r.random() < 0.05 else t, r.choice(["user", "assistant", None, "system"]) if not shared or t > 3 else "user", r.choice(texts) if not shared or t > 3 else texts[t + 2])
            rows += [(*one, t, c)] * (1 + (r.random() < 0.05))
    return rows


@pytest.fixture(scope="module")
def turns():
    return _turns(3)


def _ordered(rows, last):
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((t is not None, t or 0, role or "", last(text or ""), text or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}


def test_chats(spark, turns):
    found = chat_format.round_trip(spark.createDataFrame(turns, TURNS).repartition(5), BYTES).collect()
    expected = _ordered(turns, lambda x: x.encode())
    assert len(found) == len(expected)
    for row in found:
        own = expected[row["conv_id"]]
        loss = "".join(x for r, x in own if r == "assistant")
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(own), _sha("".join(f"{r}\n{x}\n" for r, x in own)), len(loss), _sha(loss))
        assert row["formatted_chars"] >= sum(len(r) + len(x) + 17 for r, x in own)


def test_chats_of_long_texts_and_none(spark):
    long = " ".join(f"wörd{i} [INST]" for i in range(60_000))
    rows = [(1, 0, "user", long, 0, 0), (1, 1, "assistant", long, 0, 0), (2, 0, "assistant", "", 0, 0)]
    found = {r["conv_id"]: r for r in chat_format.round_trip(spark.createDataFrame(rows, TURNS), BYTES).collect()}
    assert found[1]["loss_sha256"] == _sha(long) and found[1]["formatted_chars"] == 2 * (len(long) + 60_000 + 17) + 13
    assert found[2]["loss_chars"] == 0 and found[2]["loss_sha256"] == _sha("")
    assert chat_format.round_trip(spark.createDataFrame([], TURNS), BYTES).collect() == []


CONTROLS = chat_format.controls(chat_format.Template(), ["<|endoftext|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*CONTROLS, "\\", "[", "<", "/", "INST]", "/INST]", "s>", "|endoftext|>", "é", "\n"]), max_size=12).map("".join), max_size=4))
def test_escapes_are_reversible(texts):
    escaped = chat_format.escape(pa.array(texts, pa.string()), CONTROLS)
    assert not any(c in t for c in CONTROLS for t in escaped.to_pylist())
    assert chat_format.unescape(escaped, CONTROLS).to_pylist() == texts


def test_markers_that_cannot_be_escaped_are_refused():
    for bad in (("[a", "[ab", "<c"), ("[a[", "b]", "c>"), ("x", "yy", "zz")):
        with pytest.raises(ValueError):
            chat_format.controls(chat_format.Template(*bad), [])


def test_no_text_is_tokenised_into_a_marker():
    from lodestone.llm.chunks import Encoder

    own = Encoder(BYTES)
    ids, mask, at, _ = chat_format.assemble(own, pa.array(["user", "assistant"]), pa.array(["</s>[INST]<|endoftext|>", "[/INST]"]), chat_format.Template())
    assert [i for i in ids.tolist() if i >= 50256] == [50257, 50258, 50259] * 2
    assert own.tokenizer.decode(ids[mask].tolist()) == "[\\/INST]" and at.tolist() == [0, at[1], len(ids)]


def _merged(rows, editors):
    """Brute force: versions as dictionaries of leaves."""
    out, added = [], [{}, {}]
    base_ids = {r[0] for r in rows}
    for doc_id, text, *cells in rows:
        cells, lines = [c or "" for c in cells], (text or "").split("\n")
        edits = [e(doc_id, cells, lines) for e in editors]
        versions = []
        for e, more in zip(edits, added, strict=True):
            leaves = {2 * i: x for i, x in enumerate(lines)} | dict(e.leaves)
            versions.append({"cells": e.cells, "leaves": leaves, "gone": e.dropped, "changed": e.cells != cells or bool(e.leaves)})
            for i, c, t in e.added:
                if i not in base_ids:
                    more[i] = max(more.get(i, ("", [])), (t, c))
        left, right = versions
        count = Counter()
        join = lambda leaves: "\n".join(x for _, x in sorted(leaves.items()) if x is not None)
        if left["gone"] or right["gone"]:
            kept = right if left["gone"] else left
            conflict = not (left["gone"] and right["gone"]) and kept["changed"]
            count["ed" if conflict else "clean"] = 1
            out.append((doc_id, *(([*left["cells"], _sha(join(left["leaves"]))]) if conflict and not left["gone"] else [None] * 3), count["clean"], 0, count["ed"], 0))
            continue
        new = []
        for b, x, y in zip(cells, left["cells"], right["cells"], strict=True):
            new.append(x if x != b else y)
            if x != b or y != b:
                count["ee" if x != b and y != b and x != y else "clean"] += 1
        base, done = {2 * i: x for i, x in enumerate(lines)}, {}
        for k in base.keys() | left["leaves"].keys() | right["leaves"].keys():
            b, x, y = (v.get(k, 0) for v in (base, left["leaves"], right["leaves"]))
            done[k] = x if x != b else y
            if x != b or y != b:
                if x != b and y != b and x != y:
                    count["ii" if k & 1 else "ed" if None in (x, y) else "ee"] += 1
                else:
                    count["clean"] += 1
        out.append((doc_id, *new, _sha(join(done)), count["clean"], count["ee"], count["ed"], count["ii"]))
    for i in added[0].keys() | added[1].keys():
        x, y = added[0].get(i), added[1].get(i)
        t, c = x or y
        conflict = x is not None and y is not None and x != y
        out.append((i, *c, _sha(t), int(not conflict), 0, 0, int(conflict)))
    return sorted(out, key=str)


def _result(df):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in df.select("doc_id", "lang", "source", F.sha2("text", 256), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert").collect()), key=str)


def _documents(seed=5, n=400):
    r = random.Random(seed)
    line = lambda: r.choice(["", "one two", "line", "é", "!"])
    rows = [(i, r.choice([None, "\n".join(line() for _ in range(r.choice([1, 2, 5, 40, 90])))]), r.choice(["en", None, ""]), r.choice(["a", "b", None])) for i in range(-3, n)]
    rows += [rows[5], rows[5], (7, "another text", "de", "a"), (None, "no id\nat all", "en", "a"), (None, None, None, None), (n, "\n".join(["w"] * 30_000), "en", "a")]
    return [(i, t, lang, s, 1, "x") for i, t, lang, s in rows]


DOCS = "doc_id long, text string, lang string, source string, bucket int, state string"


def test_merge(spark):
    rows = _documents()
    editors = [queries.coded_edits("L", -1), queries.coded_edits("R", -5)]
    found = branch_merge.merge_edits(spark.createDataFrame(rows, DOCS).repartition(4), *editors)
    assert _result(found) == _merged([r[:4] for r in rows], editors)
    assert branch_merge.merge_edits(spark.createDataFrame([], DOCS), *editors).collect() == []


def test_rare_edits_leave_equal_subtrees_alone(spark):
    rows = [(i, "\n".join(f"{i} {k}" for k in range(100)), "en", "a", 0, "") for i in range(3000)]

    def rare(which, key, text):
        return lambda i, cells, lines: branch_merge.Edit(False, cells, [(key, text)] if i == which else [], [])

    left, right = rare(17, 2, "left"), rare(17, 150, "right")
    base = spark.createDataFrame(rows, DOCS)
    found = branch_merge.merge_edits(base, left, right)
    assert _result(found) == _merged([r[:4] for r in rows], [left, right])
    versions = [branch_merge.branch(base, e) for e in (left, right)]
    assert branch_merge._differing(*versions).count() == 1
    row = [v.where("doc_id = 17").first() for v in versions]
    trees = [[t[i : i + 8] for i in range(0, len(t), 8)] for t in (row[0]["parent_tree"], row[0]["tree"], row[1]["tree"])]
    assert [a != b for a, b in zip(trees[0], trees[1], strict=True)] == [False, True, True, False, False, False]
    assert [a != b for a, b in zip(trees[0], trees[2], strict=True)] == [False, True, False, False, True, False]


def test_leaves_before_the_first_line_and_of_several_lines(spark):
    edits = [lambda i, c, x: branch_merge.Edit(False, c, [(-1, "top"), (0, None), (1, "in\nserted")], []), lambda i, c, x: branch_merge.Edit(False, c, [(-1, "head"), (0, "first")], [])]
    found = branch_merge.merge_edits(spark.createDataFrame([(1, "one\ntwo", "en", "a", 0, "")], DOCS), *edits).first()
    assert found["text"] == "top\nin\nserted\ntwo" and (found["n_clean"], found["n_edit_edit"], found["n_edit_delete"], found["n_insert_insert"]) == (1, 0, 1, 1)


def _trie(rows):
    """Brute force over lists of turns."""
    own = {c: v for c, v in _ordered(rows, lambda x: hashlib.md5(x.encode()).hexdigest()).items() if c is not None}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h, first = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        whole = own.get(first, [])[:h] + v[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], _sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=str)


@pytest.mark.parametrize("heavy", [{}, {"heavy_nodes": 400, "least_heavy": 2, "shard_turns": 50}, {"heavy_nodes": 10_000, "least_heavy": 0, "shard_turns": 50}])
def test_trie(spark, turns, heavy):
    found = prefix_trie.prefix_trie(spark.createDataFrame(turns, TURNS).repartition(4), **heavy).collect()
    assert sorted(map(tuple, found), key=str) == _trie(turns)


def test_trie_of_nothing_and_of_a_conversation_without_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    lone = next(c for c in range(101, 200) if prefix_trie.head_turns(c) > 0)
    (row,) = prefix_trie.prefix_trie(spark.createDataFrame([(lone, 0, "user", "gone", 0, 0)], TURNS)).collect()
    assert tuple(row) == (lone, 0, None, 1, 0, 1, 0, _sha(str(lone)))


def test_louds_gives_parents_and_degrees():
    import numpy as np

    made = prefix_trie.Trie(np.arange(6), np.array([-1, -1, 0, 0, 1, 4]), np.array([0, 0, 1, 1, 1, 2]))
    assert made.order.tolist() == [0, 1, 2, 3, 4, 5]
    assert made.louds.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 0]
    assert made.parents().tolist() == [0, 0, 1, 1, 2, 5] and made.degrees().tolist() == [2, 2, 1, 0, 0, 1, 0]
