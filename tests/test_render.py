"""Texts of results, live values, lists, handler search."""

from pyspark.sql import functions as F

from lodestone.functions import render, text
from lodestone.functions.embedding import embedder
from lodestone.operators import paths, traindata
from lodestone.operators.graph import node_stats
from lodestone.operators.vector_search import HyperplaneIndex
from lodestone.session import shared_dir
from lodestone.sources import texts


def _text(spark, f, schema, *values):
    df = spark.createDataFrame([values], schema)
    return df.select(f(F.struct(*df.columns)).alias("t")).first()["t"]


def test_texts(spark):
    scan = "path string, files array<string>, functions array<string>, structs array<string>, description string, live_value string, confidence string"
    assert _text(spark, render.scan_text, scan, "/p", ["a.c", "b.c"], [], ["s"], "What it is.", "5", "high") == "X-RAY: /p\nConfidence: high\n\nSource: a.c, b.c\nHandlers: unknown\nStructs: s\nLive value: 5\n\nWhat it is."
    assert "Live value" not in _text(spark, render.scan_text, scan, "/p", [], [], [], "d", None, "low")
    snap = "struct_name string, instance_id string, captured_at string, context string, fields array<struct<name:string,c_type:string,value:string>>"
    assert _text(spark, render.snapshot_text, snap, "rq", "0", "now", "", [("nr", "int", "3"), ("x", "long", "-1")]) == "LIVE SNAPSHOT: rq @ 0\nCaptured: now\n\n  .nr (int) = 3\n  .x (long) = -1"
    process = "pid int, comm string, ppid int, state string, cpu int, priority int, flags string, mm_ptr string, files_ptr string"
    assert _text(spark, render.process_text, process, 7, "sh", 1, "R", 0, 120, "0x0", "0x1", "0x2") == "Process [7] sh\n  ppid=1, state=R, cpu=0, prio=120\n  flags=0x0, mm=0x1, files=0x2"
    at = "address long, file string, line int, function string, start long, end long, symbol string, symbol_start long, node string"
    full = _text(spark, render.address_text, at, 4116, "a.c", 9, "f", 4096, 4200, "f", 4096, "a.c::f")
    assert full.split("\n") == ["addr2line: 0x0000000000001014", "  Source:   a.c:9", "  Function: f()+0x14", "  Range:    0x0000000000001000–0x0000000000001068", "  Symbol:   f+0x14 (kallsyms)", "  Mirror:   a.c::f"]
    assert _text(spark, render.address_text, at, 16, None, None, None, None, None, None, None, None) == "addr2line: 0x0000000000000010"


def test_source_refs_fall_back(spark):
    rows = [(4116, "a.c", 9, "f", 4096, "d.c", 3), (4116, "a.c", 9, None, None, None, None), (4116, None, None, "f", 4096, "d.c", 3), (16, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a long, file string, line int, name string, start long, df string, dl int")
    got = [r["t"] for r in df.select(render.source_ref(*(F.col(c) for c in df.columns)).alias("t")).collect()]
    assert got == ["a.c:9 [f+0x14]", "a.c:9", "d.c:3 [f+0x14]", "0x0000000000000010 (unknown)"]


def test_lists_and_similarity(spark):
    row = spark.createDataFrame([("a,,b,", None, 0.25)], "x string, y string, z double").select(render.split_list(F.col("x")).alias("x"), render.split_list(F.col("y")).alias("y"), render.similarity(F.col("z")).alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == (["a", "b"], [], 0.75)


def test_live_values(spark, tmp_path):
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "mtu").write_text("  1500\n")
    (tmp_path / "long").write_text("x" * 900)
    got = {r["path"]: r["value"] for r in texts.live_values(spark, f"file://{tmp_path}").collect()}
    assert got == {"/net/mtu": "1500", "/long": "x" * 256}


def test_handlers_are_functions(spark):
    embed = embedder(32)
    rows = spark.createDataFrame([(1, "mtu show store net eth0", "function"), (2, "mtu show store net eth0", "struct"), (3, "page fault", "function")], "id long, code string, node_type string").select("id", embed("code").alias("v"), "node_type")
    index = HyperplaneIndex.build(rows, f"{shared_dir(spark)}/lodestone/test-handlers", bits=2)
    asked = spark.createDataFrame([("/sys/class/net/eth0/mtu ",), ("/sys/class/net/eth0/mtu",)], "path string")
    found = paths.handler_hits(asked, index, embed, 5, share=1.0).orderBy("rank").collect()
    assert [(r["path"], r["rank"], r["id"]) for r in found] == [("/sys/class/net/eth0/mtu", 1, 1), ("/sys/class/net/eth0/mtu", 2, 3)]


def test_generator_and_statistics(spark):
    code = "int f(void) { return helper(1) + other(2); }"
    nodes = spark.createDataFrame([(i, f"f{i}", f"{'mm' if i < 3 else 'net'}/a.c", code + " " * i, "Gives back the sum of two calls. More.", ["helper"] if i % 2 else ["helper", "other", ""]) for i in range(5)] + [(9, "tiny", "mm/b.c", "int x;", "", ["helper"])], "id int, symbol_name string, file_path string, code string, docstring string, calls array<string>")
    index = {r["callee"]: (r["callers"], r["subsystems"]) for r in traindata.callers_index(nodes).collect()}
    assert index == {"helper": ([0, 1, 2, 3, 4, 9], ["mm", "net"]), "other": ([0, 2, 4], ["mm", "net"])}
    made = traindata.generated(traindata.strategies(nodes), most=3).collect()
    assert {r["source"]: sum(x["source"] == r["source"] for x in made) for r in made} == {"symbol": 3, "docstring": 3, "caller_callee": 2, "subsystem": 1}
    assert {r["query"]: r["positives"] for r in made if r["source"] == "caller_callee"} == {"find functions that call helper": [0, 1, 2, 3, 4], "find functions that call other": [0, 2, 4]}
    edges = spark.createDataFrame([("0", "1", "CALLS")], "src string, dst string, edge_type string")
    stats = {(r["metric"], r["key"]): r["n"] for r in node_stats(nodes.withColumn("node_type", F.lit("function")).withColumn("layer", F.lit(1)), edges).collect()}
    assert stats == {("nodes", ""): 6, ("edges", ""): 1, ("symbols", ""): 6, ("layer", "1"): 6, ("node_type", "function"): 6, ("edge_type", "CALLS"): 1}


def test_a_first_sentence_is_worked_out_once(spark):
    """Its steps were written out anew wherever it was named: dozens of passes over every text."""
    rows = spark.createDataFrame(
        [
            (1, "/** Returns the\n * value of x. Then more. */"),
            (2, "Short."),
            (3, "no full stop here at all"),
            (4, "A sentence; with { more ; signs { than fit. End"),
            (5, "x" * 301 + ". End"),
            (6, "A sentence that fits. " + "y" * 400),
            (7, "   \n\n\n * starred line that goes on. and on"),
            (8, " "),
            (9, None),
        ],
        "id long, text string",
    )
    found = traindata.sentence_queries(rows, text.first_sentence(F.col("text")))
    assert {r["positives"][0]: r["query"] for r in found.collect()} == {1: "Returns the value of x.", 3: "no full stop here at all", 6: "A sentence that fits.", 7: "starred line that goes on."}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 3
    code = rows.select(text.first_sentence(F.lit(""), F.lit("int a; /* the comment of a block */\n// and a line")).alias("b"), text.first_sentence(F.lit(None).cast("string"), F.lit("int a; // the comment of a line\n")).alias("l")).first()
    assert (code["b"], code["l"]) == ("the comment of a block", "the comment of a line")
