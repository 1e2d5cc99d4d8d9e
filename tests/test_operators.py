import bisect
import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import address, text
from lodestone.functions.embedding import embedder
from lodestone.functions.vectors import cosine
from lodestone.operators import asof, bm25, evaluate, graph, lookup, metrics, patches, paths, prompts, proposals, search, store, traindata
from lodestone.sources import c_source, debug_info, texts
from lodestone.sources import texts as text_sources
from lodestone.streaming import index

C = {
    "net/core/dev.c": """#include <linux/dev.h>
#include "local.h"
#define DEV_LIMIT 4096
#define DEV_NAME(x) do { \\
    use(x); \\
} while (0)
#define TINY 1
struct net_dev {
    int id;
    struct inner { int a; } in;
};
struct forward;
enum dev_state { UP, DOWN };
/*
 * Sends one packet.
 */
static int dev_send(struct net_dev *d, int n)
{
    /* if (x) { not_a_call(); } */
    const char *s = "fake(call) {";
    if (n > DEV_LIMIT)
        return -1;
    d->ops->xmit(d);
    __hidden(d);
    return helper(n);
}
""",
    "net/core/helper.c": '#include "core/dev.c"\nint helper(int n)\n{\n\treturn n;\n}\nstruct net_dev **find(void)\n{\n\treturn 0;\n}\n',
    "include/linux/dev.h": "#include <linux/base.h>\nunion both { int a; long b; };\n",
}


@pytest.fixture(scope="module")
def nodes(spark):
    return c_source.nodes(spark.createDataFrame(list(C.items()), "path string, content string")).cache()


def test_c_extraction(nodes):
    got = {r["id"]: r for r in nodes.collect()}
    kinds = {(r["symbol_name"], r["node_type"]) for r in got.values()}
    assert {("net_dev", "struct"), ("inner", "struct"), ("dev_state", "enum"), ("both", "union"), ("dev_send", "function"), ("helper", "function"), ("find", "function"), ("DEV_LIMIT", "macro"), ("DEV_NAME", "macro")} <= kinds
    assert not {"forward", "TINY"} & {s for s, _ in kinds}
    send = got["net/core/dev.c::dev_send"]
    assert send["calls"] == ["helper"] and "Sends one packet." in send["docstring"] and send["uses_structs"] == ["net_dev"]
    assert (send["line_start"], send["line_end"]) == (17, 26)
    assert got["net/core/dev.c::__file__"]["includes"] == ["linux/dev.h", "local.h"]


def test_edges(nodes):
    got = {(r["src"], r["dst"], r["edge_type"]) for r in graph.resolve_edges(nodes).collect()}
    assert ("net/core/dev.c::dev_send", "net/core/helper.c::helper", "CALLS") in got
    assert ("net/core/helper.c::find", "net/core/dev.c::net_dev", "USES_STRUCT") in got
    assert ("net/core/dev.c::__file__", "include/linux/dev.h::__file__", "INCLUDES") in got
    assert ("net/core/helper.c::__file__", "net/core/dev.c::__file__", "INCLUDES") in got
    assert all(s != d for s, d, _ in got)


def test_reading_sources(spark, tmp_path):
    for path, code in C.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(code)
    (tmp_path / "net/test").mkdir()
    (tmp_path / "net/test/x.c").write_text("int x(void)\n{\n}\n")
    assert {r["path"] for r in c_source.read_sources(spark, str(tmp_path)).collect()} == set(C)


DIFF = """--- a/mm/slab.c
+++ b/mm/slab.c
@@ -100,7 +100,8 @@ int f(void)
 line 100
 line 101
 line 102
-line 103
+new 103
+-- new 103b
 line 104
 line 105
 line 106
@@ -200,2 +201,3 @@
 line 200
+added
 line 201
"""


def test_diff_and_apply(spark):
    found = patches.hunks(spark.createDataFrame([("d", DIFF), ("e", ""), ("f", None)], "diff_id string, text string"))
    rows = found.collect()
    assert len(rows) == 2 and rows[0]["removed_lines"][0]["line_no"] == 103 and [x["text"] for x in rows[0]["added_lines"]] == ["new 103", "-- new 103b"]
    files = spark.createDataFrame([("mm/slab.c", i, f"line {i}") for i in range(1, 210)], "path string, line_no int, text string")
    after = [r["text"] for r in patches.apply_hunks(files, found).orderBy("line_no").collect()]
    want = [f"line {i}" for i in range(1, 103)] + ["new 103", "-- new 103b"] + [f"line {i}" for i in range(104, 201)] + ["added"] + [f"line {i}" for i in range(201, 210)]
    assert after == want and patches.conflicts(files, found).count() == 0
    assert patches.conflicts(files.where("line_no < 50"), found).count() == 1
    nodes = spark.createDataFrame([("a", "mm/slab.c", 90, 103), ("b", "mm/slab.c", 104, 300), ("c", "mm/slab.c", 1, 89)], "id string, file_path string, line_start int, line_end int")
    assert {(r["hunk"], r["id"]) for r in patches.affected_nodes(found, nodes).collect()} == {(0, "a"), (1, "b")}


def test_snapshots(spark):
    snaps = spark.createDataFrame([("s1", None), ("s2", "s1"), ("s3", "s2")], "id string, parent_id string")
    files = spark.createDataFrame([("s1", "a", "1"), ("s1", "b", "1"), ("s3", "a", "3"), ("s2", "a", "2")], "snapshot_id string, path string, content string")
    assert {(r["path"], r["content"]) for r in patches.file_at(snaps, files, "s3").collect()} == {("a", "3"), ("b", "1")}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=30), st.lists(st.integers(0, 500), min_size=1, max_size=30))
def test_asof_equals_bisect(spark, left, right):
    a = spark.createDataFrame([(i, t) for i, t in enumerate(left)], "i int, t int")
    b = spark.createDataFrame([(t, n) for n, t in enumerate(right)], "t int, n int")
    ordered = sorted((t, n) for n, t in enumerate(right))
    want = {}
    for i, t in enumerate(left):
        at = bisect.bisect_right(ordered, (t, 1 << 30))
        want[i] = ordered[at - 1][1] if at else None
    for bucket in (None, F.floor(F.col("t") / 37)):
        got = {r["i"]: r["match"]["n"] if r["match"] else None for r in asof.asof_join(a, b, "t", bucket=bucket, tie="n").collect()}
        assert got == want


def test_addresses(spark):
    lines = spark.createDataFrame([(1, "ffffffff811abc04 T tg_up"), (2, "0000000000000000 t none"), (3, "ffffffff811abd00 t two\t[mod]"), (4, "bad line")], "line_no int, value string")
    symbols = texts.symbols(lines)
    rows = {r["name"]: r for r in texts.classified(symbols).collect()}
    assert int(rows["tg_up"]["address"]) == 0xFFFFFFFF811ABC04 and rows["two"]["module"] == "mod" and not rows["two"]["is_global"] and len(rows) == 3
    asked = spark.createDataFrame([(str(0xFFFFFFFF811ABC10),), ("5",)], "a string").select(F.col("a").cast(address.U64).alias("address"))
    got = {str(r["address"]): r["match"] for r in asof.nearest_symbol(asked, symbols).collect()}
    assert got[str(0xFFFFFFFF811ABC10)]["name"] == "tg_up" and got["5"] is None
    one = spark.range(1).select(address.to_hex(F.lit(str(0xFFFFFFFF811ABC04)).cast(address.U64)).alias("h"), address.decode_unsigned(F.lit(b"\x01\x02\x00\x00\xff\xff\xff\xff\xff\xff\xff\xff"), F.lit(4), F.lit(8)).alias("n"), address.decode_unsigned(F.lit(b"\x01\x02"), F.lit(0), F.lit(2)).alias("s"), address.decode_unsigned(F.lit(b"\x01"), F.lit(0), F.lit(4)).alias("none"), address.state_name(F.lit(32)).alias("z"), address.state_name(F.lit(999)).alias("u")).first()
    assert one["h"] == "0xffffffff811abc04" and int(one["n"]) == 2**64 - 1 and int(one["s"]) == 513 and one["none"] is None and one["z"] == "EXIT_ZOMBIE" and one["u"] == "UNKNOWN(0x3e7)"


def test_containing_function(spark):
    f = spark.createDataFrame([("f", 10, 20), ("g", 30, 35)], "name string, addr_start long, addr_end long").select("name", F.col("addr_start").cast(address.U64).alias("addr_start"), F.col("addr_end").cast(address.U64).alias("addr_end"))
    a = spark.createDataFrame([(9,), (10,), (19,), (20,), (34,), (40,)], "x long").select(F.col("x").cast(address.U64).alias("address"))
    got = {int(r["address"]): r["match"]["name"] if r["match"] else None for r in asof.containing_function(a, f).collect()}
    assert got == {9: None, 10: "f", 19: "f", 20: None, 34: "g", 40: None}


def test_an_address_goes_through_one_shuffle_to_its_symbol_function_line_and_node(spark):
    """Each of the three look-ups read and shuffled all addresses, and their results were joined."""
    dec = "decimal(20)"
    frame = lambda rows, names: spark.createDataFrame([tuple(Decimal(v) if "decimal" in n and v is not None else v for v, n in zip(r, names.split(", "), strict=True)) for r in rows], names)
    asked = frame([(5,), (1010,), (1010,), (1060,), (5200,), (9000,), (None,)], f"address {dec}")
    live = frame([(1000, "b", 2), (1000, "a", 1), (0, "none", 0), (5100, "far", 3)], f"address {dec}, name string, line_no int")
    binary = frame([(900, 950, "f", "s.c", 7), (900, 920, "short", "s.c", 8), (5000, 5150, "g", "g.c", 9)], f"addr_start {dec}, addr_end {dec}, name string, source_file string, source_line int")
    lines = frame([(900, "l.c", 70), (940, "l.c", 71)], f"address {dec}, file_path string, line int")
    nodes = spark.createDataFrame([("n2", "f"), ("n1", "f"), ("x", "short")], "id string, symbol_name string")
    expected = {5: (None, None, None, None, None), 1010: ("a+0xa", "f", "l.c", 70, "n1"), 1060: ("a+0x3c", None, "l.c", 71, None), 5200: ("far+0x64", "g", "l.c", 71, None), 9000: ("far+0xf3c", None, "l.c", 71, None)}
    for bucket in (None, F.floor(F.col("address") / 100), F.floor(F.col("address") / 1000)):
        found = lookup.addr2line(asked, live, binary, lines, nodes, 100, bucket)
        got = [(int(r["address"]), (r["live_ref"], r["function"], r["file"], r["line"], r["node"])) for r in found.collect()]
        assert len(got) == 5 and dict(got) == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2  # rows, and a row a bucket
    assert found.columns == ["address", "hex", "live_ref", "function", "file", "line", "node"]


def test_layouts(spark):
    members = spark.createDataFrame([("s", "a", "int", 0, 4), ("s", "", "anon1", 8, 16), ("anon1", "b", "long", 0, 8), ("anon1", "", "anon2", 8, 8), ("anon2", "c", "int", 4, 4), ("anon2", "a", "int", 0, 4)], debug_info.MEMBER)
    got = {(r["struct_name"], r["field"]): r["byte_offset"] for r in debug_info.layouts(members).where("struct_name = 's'").collect()}
    assert got == {("s", "a"): 0, ("s", "b"): 8, ("s", "c"): 20}


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "Y"), ("c", "d", "Y"), ("d", "e", "X")], "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    hops = lambda **k: {(r["id"], r["hop"]) for r in graph.neighborhood(edges, seeds, **k).collect()}
    assert hops(hops=0) == {("a", 0)}
    assert hops(hops=2) == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert hops(hops=3, edge_types=["X"]) == {("a", 0), ("b", 1), ("c", 2)}
    assert hops(hops=3, max_nodes=2) == {("a", 0), ("b", 1)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2, 0), ("b", 3, 1), ("c", 4, 2)], "id string, v int, at int")
    assert sorted(map(tuple, graph.upsert(old, new, F.col("at")).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_bm25(spark):
    docs = spark.createDataFrame([("1", "throttle cfs bandwidth throttle"), ("2", "cfs queue"), ("3", "unrelated words"), ("4", ""), ("5", None)], "doc string, text string")
    asked = spark.createDataFrame([("q", "throttle cfs cfs"), ("none", "zzz the of")], "query string, text string")
    got = bm25.Index(docs).search(asked, 10).collect()
    assert [r["doc"] for r in got] == ["1", "2"] and got[0]["score"] > got[1]["score"] > 0


def test_ranks_share_ties(spark):
    gaps = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0)], "query string, gap double")
    assert {r["query"]: r["difficulty"] for r in bm25.difficulty_rank(gaps).collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_metrics(spark):
    results = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("q", 3, "z")], "query string, rank int, doc string")
    relevant = spark.createDataFrame([("q", "y"), ("q", "w"), ("r", "w")], "query string, doc string")
    got = {r["query"]: r for r in metrics.ranking_metrics(results, relevant, 2).collect()}
    assert got["q"]["mrr"] == 0.5 and got["q"]["recall"] == 0.5 and got["q"]["ndcg_retrieved"] == round(1 / 1.584962500721156, 6)
    assert (got["r"]["mrr"], got["r"]["recall"], got["r"]["ndcg"]) == (0.0, 0.0, 0.0)


@settings(max_examples=10, deadline=None)
@given(st.floats(0, 1), st.integers(0, 5), st.floats(0, 1))
def test_curriculum(spark, hard, epoch, difficulty):
    one = spark.range(1).select(traindata.curriculum_ratio(F.lit(hard), F.lit(epoch), F.lit(6), F.lit(difficulty)).alias("r"), traindata.curriculum_ratio(F.lit(hard), F.lit(5), F.lit(6), F.lit(difficulty)).alias("last")).first()
    assert -1e-12 <= one["r"] <= one["last"] + 1e-12 and abs(one["last"] - hard) < 1e-9


def test_training_items(spark):
    rows = spark.createDataFrame([("q", ["p"], ["h1", "h2", "h3"], ["e1", "e2", "e3"], 1.0)], "query string, positives array<string>, hard_negatives array<string>, easy_negatives array<string>, difficulty double")
    first, last = (traindata.training_items(rows, 3, e, 2, 7).first()["negatives"] for e in (0, 1))
    assert {x[0] for x in first} == {"e"} and {x[0] for x in last} == {"h"}


def test_text_functions(spark):
    one = spark.createDataFrame([("Fix NULL ptr in tg_throttle_up 10 a int", "sched/fair: fix it", "/** Returns the value. Then more. */")], "t string, s string, d string").select(text.tokens(F.col("t")).alias("t"), text.subject_subsystem(F.col("s")).alias("s"), text.first_sentence(F.col("d")).alias("d")).first()
    assert one["t"] == ["fix", "null", "ptr", "tg_throttle_up", "10"] and one["s"] == "sched" and one["d"] == "Returns the value."


def test_embedder(spark):
    rows = spark.createDataFrame([("alpha beta",), ("",), (None,)], "t string").select(embedder(16)("t").alias("v"))
    got = [r["v"] for r in rows.collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and got[1] == got[2] == [0.0] * 16
    assert rows.select(cosine(F.col("v"), F.col("v")).alias("c")).collect()[1]["c"] == 0


def test_budget_keeps_one(spark):
    rows = spark.createDataFrame([("q", 1, 900), ("q", 2, 50), ("r", 1, 10), ("r", 2, 20), ("r", 3, 500)], "query string, rank int, size int")
    assert {(r["query"], r["rank"]) for r in search.within_budget(rows, 100).collect()} == {("q", 1), ("r", 1), ("r", 2)}


def test_streaming_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"doc": str(i), "text": "cfs throttle cfs", "at": "2024-01-01T00:00:00"}) + "\n")
    docs = index.documents(spark, str(tmp_path / "in"), 1)
    index.run(docs, str(tmp_path / "postings"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "postings"))
    assert got.count() == 6 and got.where("term = 'cfs'").first()["tf"] == 2
    assert index.arrivals(docs).isStreaming


# --- added with the workflows ----------------------------------------------------------


def test_noise_of_commits(spark):
    long = " of a driver that is long enough"
    subjects = ["Merge branch" + long, "revert \"x\"" + long, "Linux 6.1" + long, "fixup! fix" + long, "ANDROID: fix" + long, "CHROMIUM: fix" + long, "Bump version" + long, "Signed-off-by" + long, "MAINTAINERS: add" + long, "mm: fix a typo in the whitespace checkpatch complains about", "short"]
    rows = spark.createDataFrame([(s, ["a.c"], ["a.c::f"]) for s in subjects] + [("a subject that is long enough", ["a.h"], ["x"]), ("another subject that is long", ["a.h", "b.c"], []), ("another subject that is long", ["a.c"], ["x"] * 9)], "subject string, files array<string>, positives array<string>")
    assert [r["subject"] for r in traindata.useful_commits(rows).collect()] == ["mm: fix a typo in the whitespace checkpatch complains about"]


def test_additions_come_after_their_own_lines(spark):
    diff = "--- a/f\n+++ b/f\n@@ -1,5 +1,5 @@\n-a\n b\n c\n+new\n d\n-e\n+E\n"
    pure = "--- a/g\n+++ b/g\n@@ -1,0 +2,2 @@\n+x\n+y\n"
    found = patches.hunks(spark.createDataFrame([("p", diff), ("q", pure)], "diff_id string, text string"))
    files = spark.createDataFrame([("f", "a\nb\nc\nd\ne\n"), ("g", "1\n2\n"), ("h", "same")], "path string, content string")
    after, before = proposals.applied(files, found)
    assert {r["path"]: r["content"] for r in after.collect()} == {"f": "b\nc\nnew\nd\nE\n", "g": "1\nx\ny\n2\n", "h": "same"}
    assert {r["path"]: r["content"] for r in proposals.reverted(after, before).collect()} == {r["path"]: r["content"] for r in files.collect()}


def test_strict_application_refuses(spark):
    diff = "--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-other\n+new\n"
    found = patches.hunks(spark.createDataFrame([("p", diff)], "diff_id string, text string"))
    files = spark.createDataFrame([("f", "a\n")], "path string, content string")
    with pytest.raises(proposals.Conflict):
        proposals.applied(files, found)
    assert proposals.dry_run(files, found).first()["conflicts"] == 1
    assert proposals.applied(files, found, strict=False)[0].first()["content"] == "new\n"


def test_long_chains_of_snapshots(spark):
    snaps = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None) for i in range(40)], "id string, parent_id string")
    files = spark.createDataFrame([("s0", "old", "0"), ("s3", "mid", "3"), ("s0", "mid", "0"), ("s39", "new", "39")], "snapshot_id string, path string, content string")
    assert {(r["path"], r["content"]) for r in patches.file_at(snaps, files, "s39").collect()} == {("old", "0"), ("mid", "3"), ("new", "39")}


def test_deep_anonymous_members(spark):
    rows = [("s", "", "t0", 0, 8)] + [(f"t{i}", "", f"t{i + 1}", 1, 8) for i in range(12)] + [("t12", "x", "int", 2, 4)]
    members = spark.createDataFrame(rows, "parent string, name string, type string, byte_offset int, byte_size int")
    assert [(r["field"], r["byte_offset"]) for r in debug_info.layouts(members).where("struct_name = 's'").collect()] == [("x", 14)]


def test_lines_of_files_by_suffix(spark):
    rows = spark.createDataFrame([(10, "a/b/c.c", 5, True), (11, "x/c.c", 5, True), (12, "a/b/c.c", 6, True), (13, "a/b/c.c", 5, False)], "address long, file_path string, line int, is_stmt boolean")
    wanted = spark.createDataFrame([("b/c.c", 5), ("c.c", 6)], "file string, line int")
    assert sorted((r["file"], r["address"]) for r in debug_info.addresses_of(rows, wanted).collect()) == [("b/c.c", 10), ("c.c", 12)]


def test_neighbourhood_of_many_hops(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "E") for i in range(8)], "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([("n0",)], "id string")
    for hops in range(1, 7):
        assert sorted((r["id"], r["hop"]) for r in graph.neighborhood(edges, seeds, hops).collect()) == [(f"n{i}", i) for i in range(hops + 1)]


def test_prompt_shrinks_and_is_marked(spark):
    rows = spark.createDataFrame([(1, "q", "s", ["b" * 1000] * 14, ""), (2, "q", "s", ["b" * 90_000], "l" * 90_000), (3, "q", "s", [], None)], "query int, question string, system string, blocks array<string>, live string")
    got = {r["query"]: r for r in prompts.assembled(rows, 2000).collect()}
    assert got[1]["nodes"] == 4 and "truncated" not in got[1]["prompt"]
    assert got[2]["nodes"] == 1 and got[2]["prompt"].count("[truncated for token budget]") == 2 and got[2]["tokens"] <= 2000
    assert got[3]["nodes"] == 0


def test_providers():
    prompts.PROVIDERS["echo"] = lambda model, prompt: iter([model, ":", prompt])
    assert prompts.answer("echo:m1", "hi") == "m1:hi" and prompts.provider("llama3") == ("ollama", "llama3")
    assert prompts.provider("openai:gpt-4o") == ("openai", "gpt-4o") and prompts.provider("ollama:coder:6.7b") == ("ollama", "coder:6.7b")
    with pytest.raises(LookupError):
        prompts.answer("openai:gpt-4o", "hi")
    with pytest.raises(LookupError):
        prompts.answer("llama3", "hi")


def test_answers_come_with_their_sources(spark):
    asked = spark.createDataFrame([(1, "why?", 10), (2, "how?", 5), (3, None, 1)], "query int, prompt string, tokens int")
    cited = spark.createDataFrame([(1, ["a.c:3", "b.c:1"])], "query int, sources array<string>")
    got = {r["query"]: tuple(r)[1:] for r in prompts.synthesized(asked, cited, "own:m1", lambda model, prompt: iter([model, " says ", prompt])).collect()}
    assert got == {1: ("m1 says why?", ["a.c:3", "b.c:1"], "own:m1", 10), 2: ("m1 says how?", [], "own:m1", 5), 3: (None, [], "own:m1", 1)}
    with pytest.raises(LookupError):
        prompts.synthesized(asked, cited, "nobody:m1")


def test_gold_ids_of_files_and_symbols(spark):
    nodes = spark.createDataFrame([("a.c::f", "f"), ("b.c::f", "f"), ("a.c::g", "g")], "id string, symbol_name string")
    gold = spark.createDataFrame([(1, ["z"], None, None), (2, None, ["g", "none"], ["a.c", "b.c"])], "query int, relevant_ids array<string>, expected_symbols array<string>, expected_files array<string>")
    assert sorted((r["query"], r["id"]) for r in evaluate.gold_ids(gold, nodes).collect()) == [(1, "z"), (2, "a.c::g")]


def test_first_rule_that_matches_a_whole_path(spark):
    asked = spark.createDataFrame([("/proc/12/stat",), ("/proc/12/status",), ("/proc/meminfo",), ("/proc/meminfo2",), (" /sys/block/sda/queue/scheduler ",)], "path string")
    got = {r["path"]: (r["functions"], r["confidence"]) for r in paths.scanned(asked, paths.rules(spark)).collect()}
    assert got["/proc/12/stat"] == (["do_task_stat"], "high") and got["/proc/12/status"][0] == ["proc_pid_status"]
    assert got["/proc/meminfo2"] == ([], "low") and got["/sys/block/sda/queue/scheduler"][1] == "high"
    assert paths and [r["q"] for r in asked.limit(1).select(paths.scan_query(F.col("path")).alias("q")).collect()] == ["sysfs attribute stat show read write store handler function 12 kernel"]


def test_saved_index_equals_the_one_in_memory(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None)], "doc long, text string")
    index = bm25.Index(docs)
    index.save(f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(7, "beta alpha")], "query long, text string")
    saved = bm25.Index.load(spark, f"file://{tmp_path}/i")
    assert sorted(saved.search(asked).collect()) == sorted(index.search(asked).collect())
    one = spark.createDataFrame([(1, "gamma")], "query long, text string")
    terms = {r["term"] for r in saved._of(one.selectExpr("query", "text AS term")).collect()}
    assert "gamma" in terms and saved.search(one).count() == 1
    empty = bm25.Index(docs.limit(0))
    empty.save(f"file://{tmp_path}/e")
    assert bm25.Index.load(spark, f"file://{tmp_path}/e").search(asked).count() == 0


def test_a_store_without_versions_is_empty(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/s", "id string, symbol_name string, node_type string, layer int")
    assert own.nodes.count() == 0 and own.edges.count() == 0
    own.add(spark.createDataFrame([("a", "f", "function", 1)], own.nodes.schema))
    assert own.get(spark.createDataFrame([("a",), ("b",)], "id string")).count() == 1
    assert own.find(spark.createDataFrame([("f",)], "symbol_name string")).count() == 1


def test_reports_and_logs(spark, tmp_path):
    one = spark.createDataFrame([(1, 0.5)], "query int, recall double")
    store.write_report(one, one, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/queries").count() == 1
    log = spark.createDataFrame([("abc|2024-01-02T03:04:05+00:00|mm: fix | it\na.c\nREADME",), ("def|2023-01-02|x\nREADME",)], "value string")
    assert [tuple(r[c] for c in ("sha", "subject", "files")) for r in text_sources.commits(log).collect()] == [("abc", "mm: fix | it", ["a.c"])]
    starts = text_sources.hunk_starts(spark.createDataFrame([("s", "f", "@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n")], "sha string, file string, text string"))
    assert [r["line"] for r in starts.orderBy("nth").collect()] == [3, 12]


def test_file_names_of_units(spark):
    lines = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "cu int, file_no int, line int")
    files = spark.createDataFrame([(1, 1, "/build/linux/mm", "slab.c")], "cu int, file_no int, dir string, name string")
    assert {r["line"]: r["file_path"] for r in debug_info.file_names(lines, files).collect()} == {10: "mm/slab.c", 11: None}


def test_scratch_is_refused_on_a_cluster(spark, monkeypatch):
    from lodestone import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_references_by_a_summary_and_suffixes_without_products(spark, capfd):
    rows = [("a", "s", ["s", "t"]), ("b", "s", ["s"]), ("b", "s", ["t", "x"]), ("c", "t", ["t", None]), ("d", None, ["s"]), (None, "s", ["s"])]
    nodes = spark.createDataFrame(rows, "id string, symbol_name string, calls array<string>")
    want = graph.reference_edges(nodes, "calls", "CALLS").groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("first"), F.max("dst").alias("last"))
    found = graph.reference_summary(nodes, "calls")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # 3,000 paths that end alike would be 9 million pairs; the join's widest step may not exceed two a reference.
    files = spark.range(3000).selectExpr("id", "concat('d', id, '/x.h') AS file_path")
    refs = spark.range(3000).selectExpr("id AS src", "0 AS ordinal", "'x.h' AS ref")
    met = graph.suffix_join(refs, files)
    assert {(r["src"], r["dst"]) for r in met.collect()} == {(i, 1 if i == 0 else 0) for i in range(3000)}
    capfd.readouterr()
    met.explain()
    assert "WindowGroupLimit" in capfd.readouterr().out  # two files a suffix are kept before the join
    twice = spark.createDataFrame([(1, "a/x.h"), (1, "b/x.h"), (2, "c/x.h")], "id long, file_path string")
    one = spark.createDataFrame([(1, 0, "x.h"), (3, 0, "x.h")], "src long, ordinal int, ref string")
    assert sorted(map(tuple, graph.suffix_join(one, twice).collect())) == [(1, 0, "x.h", 2), (3, 0, "x.h", 1)]


def test_postings_are_shuffled_once_and_pools_suffice(spark, capfd):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 23}" for j in range(i % 9))) for i in range(120)] + [(5, "w1 twice")], "doc long, text string")
    index = bm25.Index(docs)
    capfd.readouterr()
    index.lengths.explain()
    assert capfd.readouterr().out.count("Exchange hashpartitioning") == 1
    assert index.lengths.where("doc = 5").first()["length"] == 5 - 0 + 2
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} w3") for q in range(5)], "query long, text string")
    scores = index.scores(asked)
    pool = bm25.pool(scores, 4, 2)
    best = bm25.ranked(scores, 2).select("query", "doc")
    assert sorted(bm25.hard_negatives(pool, best, 4).collect()) == sorted(bm25.hard_negatives(scores, best, 4).collect())
    assert pool.groupBy("query").count().agg(F.max("count")).first()[0] <= 56


def test_sums_of_terms_need_no_postings(spark, capfd):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta Alpha"), (2, "alpha gamma"), (None, "gamma"), (None, "gamma beta"), (3, ""), (4, None)], "doc long, text string")
    index = bm25.Index(docs)
    assert {tuple(r) for r in index.terms().collect()} == {("alpha", 2, 3), ("beta", 3, 4), ("gamma", 2, 3)}
    assert index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).exceptAll(index.terms()).isEmpty()
    assert tuple(index.stats.first()) == (7, 10 / 7)
    capfd.readouterr()
    index.stats.explain()
    assert "hashpartitioning" not in capfd.readouterr().out  # texts lie where they are


def test_an_index_in_memory_scores_without_postings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 23}" for j in range(i % 9))) for i in range(90)] + [(5, "w1 twice"), (7, None)], "doc long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} w3") for q in range(5)], "query long, text string")
    index = bm25.Index(docs)
    index.save(f"file://{tmp_path}/i")
    want = [sorted(bm25.Index.load(spark, f"file://{tmp_path}/i").scores(asked, d).collect()) for d in (True, False)]
    monkeypatch.setattr(bm25.Index, "holding", None)  # all postings are made there
    assert want == [sorted(index.scores(asked, d).collect()) for d in (True, False)] and want[0]
