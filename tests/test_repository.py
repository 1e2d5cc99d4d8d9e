"""Stores, extraction by content, mining, previews and layouts."""

import pyarrow as pa
import pytest

from lodestone.functions.address import decoded
from lodestone.operators import extraction, mining, mod_store, patches, paths, proposals, store
from lodestone.operators.extraction import Cache
from lodestone.publish import Folder, Taken
from lodestone.sources import c_source

NODE = "id string, symbol_name string, node_type string, layer int"
HUNK = patches.HUNK


def _hunk(diff, path, at, old, new):
    return (diff, 0, path, at, at, [], [(at, old)], [(at, new)], [])


# --- publishing ---------------------------------------------------------------------------


def test_a_name_is_published_once_and_whole(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    folder.publish("a/b", {"t": one, "u": two})
    with pytest.raises(Taken):
        folder.publish("a/b", {"t": two, "u": two})
    assert [r["x"] for r in folder.read(["a/b"], "t", "x int").collect()] == [1] and folder.names("a") == ["b"] and folder.names("drafts") == []
    assert folder.read([], "t", "x int").count() == 0 and folder.names("none") == []


# --- graph store ----------------------------------------------------------------------------


def test_the_last_row_of_an_id_wins(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/s", NODE)
    own.add(spark.createDataFrame([("x", str(i), "function", 1) for i in range(50)] + [("y", "0", "struct", 1)], NODE).coalesce(1))
    assert {r["id"]: r["symbol_name"] for r in own.nodes.collect()} == {"x": "49", "y": "0"}
    own.add(spark.createDataFrame([("x", "b", "function", 3), ("x", "a", "function", 9)], NODE), "layer")
    assert {r["id"]: r["symbol_name"] for r in own.nodes.collect()} == {"x": "a", "y": "0"}


def test_no_update_is_lost_to_another_writer(spark, tmp_path, monkeypatch):
    own, other = (store.Store(spark, f"file://{tmp_path}/s", NODE) for _ in range(2))
    plain, raced = own.save, []

    def save(*args, **named):
        if not raced:
            raced.append(other.add(spark.createDataFrame([("b", "g", "function", 1)], NODE)))
        return plain(*args, **named)

    monkeypatch.setattr(own, "save", save)
    own.add(spark.createDataFrame([("a", "f", "function", 1)], NODE))
    assert sorted(r["id"] for r in own.nodes.collect()) == ["a", "b"] and own.versions() == [1, 2]
    with pytest.raises(Taken):
        plain(own.nodes, own.edges, base=1)


def test_a_version_of_another_form_is_refused(spark, tmp_path, monkeypatch):
    own = store.Store(spark, f"file://{tmp_path}/s", NODE)
    monkeypatch.setattr(store.Store, "SCHEMA_VERSION", 99)
    own.add(spark.createDataFrame([("a", "f", "function", 1)], NODE))
    monkeypatch.undo()
    with pytest.raises(ValueError):
        own.nodes.count()


def test_older_forms_are_read(spark, tmp_path):
    """Without a form, or with none that is a number, it is the first; the statistics tell it; a layer is saved alone."""
    own = store.Store(spark, f"file://{tmp_path}/s", NODE)
    assert own.schema_version() == 2 and own.nodes.count() == 0
    old = spark.createDataFrame([("a", "f", "function")], "id string, symbol_name string, node_type string")
    edges = spark.createDataFrame([("a", "a", "CALLS")], "src string, dst string, edge_type string")
    own.folder.publish("v00000001", {"nodes": old, "edges": edges})
    assert own.schema_version() == 1 and [tuple(r) for r in own.nodes.collect()] == [("a", "f", "function", None)]
    own.folder.publish("v00000002", {"nodes": old, "edges": edges, "meta": spark.createDataFrame([("odd",)], "schema_version string")})
    assert own.schema_version() == 1 and own.edges.count() == 1

    def told():
        return {(r["metric"], r["key"]): r["n"] for r in own.stats().collect()}

    assert told()[("schema_version", "")] == 1
    mixed = spark.createDataFrame([("a", "f", "function", 1), ("b", "f", "binary", 2), ("c", "f", "live", 3), ("d", "g", "struct", 1)], NODE)
    linked = spark.createDataFrame([("a", "b", "SOURCE_TO_BINARY"), ("b", "c", "BINARY_TO_LIVE"), ("a", "d", "USES_STRUCT")], edges.schema)
    for _ in range(2):
        own.save(mixed, linked, layer=1)
        assert sorted(r["id"] for r in own.nodes.collect()) == ["a", "d"] and [tuple(r) for r in own.edges.collect()] == [("a", "d", "USES_STRUCT")]
        assert told()[("schema_version", "")] == 2 and told()[("layer", "1")] == 2 and ("layer", "2") not in told()


# --- extraction and mining -------------------------------------------------------------------

CODE = "int f(void)\n{\n\treturn 1;\n}\n\nstatic int g(int a)\n{\n\treturn f() + a;\n}\n"


def test_a_second_read_extracts_nothing(spark, tmp_path, monkeypatch):
    blobs = spark.createDataFrame([("b1", CODE), ("b1", CODE), ("b2", "no code"), ("b3", None)], "blob string, content string")
    cache = Cache(spark, f"file://{tmp_path}/c")
    first = sorted(map(tuple, cache.ranges(blobs).collect()))
    assert first == [("b1", 0, "f", 1, 4), ("b1", 1, "g", 6, 9)] == sorted(map(tuple, extraction.ranges(blobs.dropDuplicates(["blob"])).collect()))
    assert sorted(r["blob"] for r in cache.known().collect()) == ["b1", "b2", "b3"]
    plain = extraction.ranges

    def refused(blobs):
        raise AssertionError("extracted again")

    monkeypatch.setattr(extraction, "ranges", refused)
    assert sorted(map(tuple, Cache(spark, f"file://{tmp_path}/c").ranges(blobs).collect())) == first
    with pytest.raises(AssertionError):
        Cache(spark, f"file://{tmp_path}/c", version=2).ranges(blobs)
    monkeypatch.setattr(extraction, "ranges", plain)
    more = blobs.union(spark.createDataFrame([("b4", CODE)], "blob string, content string"))
    assert cache.ranges(more).where("blob = 'b4'").count() == 2 and len(cache.folder.names("parts")) == 2


def test_mining_reads_logs_diffs_and_blobs_alone(spark):
    log = spark.createDataFrame([("s1|2020-01-02T00:00:00|mm/slab: a long enough subject\nmm/a.c\nREADME",), ("s2|2020-01-03|Merge branch 'of many things'\nmm/a.c",), ("s3|2010-01-03|mm: old, but long enough it is\nmm/a.c",), ("s4|2020-05-01|net: another subject of some length\nmm/a.c",)], "value string")
    diff = "@@ -1,2 +3,2 @@ int f\n-a\n+b\n@@ -8 +8 @@\n-c\n+d\n"
    files = spark.createDataFrame([(s, "mm/a.c", CODE) for s in ("s1", "s2", "s3")] + [("s4", "mm/a.c", None)], "sha string, file string, content string")
    diffs = spark.createDataFrame([(f"s{i}", "mm/a.c", diff) for i in range(1, 5)], "sha string, file string, text string")
    tree, blobs = mining.blobs_of(files)
    assert blobs.count() == 2
    rows = mining.mined(log, diffs, tree, blobs, "2018-01-01").collect()
    assert [(r["commit"], r["positives"], r["subsystem"], r["changed_files"]) for r in rows] == [("s1", ["mm/a.c::f", "mm/a.c::g"], "mm", ["mm/a.c"])]


def test_node_diff(spark):
    before = spark.createDataFrame([("a", "function", "x", ""), ("b", "function", "x", ""), ("c", "macro", "x", None), ("e", "function", "x", "old")], "id string, node_type string, code string, docstring string")
    after = spark.createDataFrame([("a", "function", "x", ""), ("b", "function", "y", ""), ("d", "function", "x", ""), ("e", "function", "x", "new")], before.schema)
    assert sorted(map(tuple, extraction.node_diff(before, after).collect())) == [("b", "changed"), ("c", "removed"), ("d", "new"), ("e", "changed")]


def test_a_preview_parses_touched_files_only(spark):
    files = spark.createDataFrame([("a.c", CODE), ("b.c", "int broken( {{{")], "path string, content string")
    hunks = spark.createDataFrame([_hunk("m", "a.c", 6, "static int g(int a)", "static int h(int a)")], HUNK)
    assert sorted(map(tuple, proposals.preview_nodes(files, hunks).collect())) == [("a.c::g", "removed"), ("a.c::h", "new")]


def test_rows_of_sources_leave_in_runs(spark):
    """A task held the rows of a whole batch of files."""
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.c" for i in range(9000)], "content": [CODE if i % 9 else None for i in range(9000)]})
    held = list(c_source.runs(batch, c_source.extract))
    assert sum(map(len, held)) == 16000 and max(map(len, held)) < 5000
    files = spark.createDataFrame([("a.c", CODE), ("b.c", None), ("c.c", '#include "x.h"\n' + CODE)], "path string, content string")
    own = ["id", "node_type", "code", "docstring"]
    found = sorted(map(tuple, c_source.bodies(files).collect()))
    assert len(found) == 5 and found == sorted(map(tuple, c_source.nodes(files).select(*own).collect()))


# --- proposals and snapshots --------------------------------------------------------------------


@pytest.fixture
def mods(spark, tmp_path):
    return mod_store.ModStore(spark, f"file://{tmp_path}/m")


FILES = [("a.c", "one\ntwo\n"), ("b.c", "x\ny\n"), ("c.c", "k\n")]


def _contents(df):
    return {r["path"]: r["content"] for r in df.collect()}


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_a_life_of_proposals(spark, mods):
    files = spark.createDataFrame(FILES, "path string, content string")
    assert mods.proposals().count() == 0 and mods.apply(files, 1) == (files, None) and mods.history().count() == 0
    mods.propose(spark.createDataFrame([_hunk("p1", "a.c", 1, "one", "ONE"), _hunk("p2", "b.c", 2, "y", "Y"), _hunk("p3", "a.c", 2, "two", "TWO"), _hunk("p4", "c.c", 1, "k", "K")], HUNK), 1)
    with pytest.raises(ValueError):
        mods.put_state(_ids(spark, "p1"), "applied", 2)
    with pytest.raises(ValueError):
        mods.put_state(_ids(spark, "nobody"), "accepted", 2)
    mods.put_state(_ids(spark, "p2"), "accepted", 3)
    mods.put_state(_ids(spark, "p1"), "accepted", 4)
    mods.put_state(_ids(spark, "p4"), "discarded", 5)
    assert [(r["position"], r["id"]) for r in mods.pending().orderBy("position").collect()] == [(1, "p2"), (2, "p1")]
    after, first = mods.apply(files, 10)
    assert _contents(after) == {"a.c": "ONE\ntwo\n", "b.c": "x\nY\n", "c.c": "k\n"}
    assert mods.pending().count() == 0 and {r["id"]: r["state"] for r in mods.proposals().collect()} == {"p1": "applied", "p2": "applied", "p3": "proposed", "p4": "discarded"}
    mods.put_state(_ids(spark, "p3"), "accepted", 11)
    last, second = mods.apply(after, 12)
    assert _contents(last)["a.c"] == "ONE\nTWO\n" and mods.snapshot_ids() == [first, second] == [1, 2]
    # The second snapshot holds a.c alone; b.c is its parent's.
    assert _contents(mods.files(2)) == {"a.c": "ONE\ntwo\n", "b.c": "x\ny\n"}
    assert _contents(mods.revert(last, 2)) == {"a.c": "ONE\ntwo\n", "b.c": "x\ny\n", "c.c": "k\n"}
    assert _contents(mods.revert(last, 1)) == dict(FILES)
    assert [(r["id"], r["parent_id"]) for r in mods.history(1).collect()] == [(2, 1)]
    with pytest.raises(LookupError):
        mods.manifest(9)


def test_a_hunk_that_does_not_fit_changes_nothing(spark, mods):
    files = spark.createDataFrame(FILES, "path string, content string")
    mods.propose(spark.createDataFrame([_hunk("p", "a.c", 1, "other", "ONE")], HUNK), 1)
    mods.put_state(_ids(spark, "p"), "accepted", 2)
    with pytest.raises(proposals.Conflict):
        mods.apply(files, 3)
    assert mods.snapshot_ids() == [] and mods.pending().count() == 1


def test_of_two_snapshots_of_one_number_one_takes_the_other_as_its_parent(spark, mods, monkeypatch):
    other = mod_store.ModStore(spark, mods.folder.root)
    files = spark.createDataFrame(FILES, "path string, content string")
    plain, raced = mods.folder.publish, []

    def publish(name, tables):
        if name.startswith("snapshots/") and not raced:
            raced.append(other.save_snapshot(files.limit(1), "first", 1))
        plain(name, tables)

    monkeypatch.setattr(mods.folder, "publish", publish)
    assert mods.save_snapshot(files, "second", 2) == 2 and raced == [1]
    assert sorted((r["id"], r["parent_id"], r["description"]) for r in mods.snapshots().collect()) == [(1, None, "first"), (2, 1, "second")]
    assert spark.read.parquet(*(f"{mods.folder.root}/blobs/{n}/rows" for n in mods.folder.names("blobs"))).count() == 3


# --- layouts and paths ------------------------------------------------------------------------------


def test_layouts_of_all_sizes_and_both_orders(spark):
    from pyspark.sql import functions as F

    raw = bytes(range(250, 256)) + bytes([255] * 4) + bytes(range(6))
    layout = [("a", 0, 1), ("b", 1, 2), ("c", 2, 4), ("d", 2, 8), ("e", 15, 1), ("f", 15, 2), ("g", 9, 8), ("h", 3, 3), ("i", -1, 1)]
    rows = spark.createDataFrame([(raw, layout), (b"", layout), (None, layout)], "raw binary, l array<struct<field:string,byte_offset:int,byte_size:int>>")
    for little in (True, False):
        got = [r["v"] for r in rows.select(decoded(F.col("raw"), F.col("l"), little).alias("v")).collect()]
        expected = {n: int.from_bytes(raw[o : o + s], "little" if little else "big") for n, o, s in layout if s in (1, 2, 4, 8) and o >= 0 and o + s <= len(raw)}
        assert {k: int(v) for k, v in got[0].items()} == expected and max(expected.values()) > 2**63 and got[1] == {} and not got[2]


def test_path_scan_says_what_it_found(spark):
    asked = spark.createDataFrame([("/proc/12/cmdline",), ("/sys/x/y_z",), ("/sys/none",)], "path string")
    hits = spark.createDataFrame([("/sys/x/y_z", 1, 0.9, "a.c", "y_show", "function", "Shows y."), ("/sys/x/y_z", 2, 0.8, "b.c", "y", "struct", ""), ("/proc/12/cmdline", 1, 0.9, "a.c", "f", "function", "no")], "path string, rank int, score double, file_path string, symbol_name string, node_type string, docstring string")
    live = spark.createDataFrame([("/sys/x/y_z ", "5")], "path string, value string")
    got = {r["path"]: r for r in paths.scanned(asked, paths.rules(spark), hits, live).collect()}
    rule, near, none = got["/proc/12/cmdline"], got["/sys/x/y_z"], got["/sys/none"]
    assert rule["structs"] == ["mm_struct", "task_struct"] and rule["confidence"] == "high" and "arguments" in rule["description"] and rule["live_value"] is None
    assert (near["files"], near["functions"], near["structs"], near["description"], near["live_value"], near["confidence"]) == (["a.c", "b.c"], ["y_show"], ["y"], "Shows y.", "5", "medium")
    assert none["files"] == [] and none["description"] == paths.UNKNOWN and none["confidence"] == "low"
