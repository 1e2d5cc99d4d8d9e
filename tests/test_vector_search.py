"""Block search, hyperplane buckets, losses and the embedder against plain numpy."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.functions.embedding import BASE, chunk_vectors, embedded, embedder
from lodestone.operators import search, vector_search
from lodestone.operators.vector_search import HyperplaneIndex, probes
from lodestone.session import shared_dir


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((600, 12)), 2)
    v[10] = v[11] = v[12]  # ties
    return v


def _frame(spark, v, extra=()):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "id long, v array<double>")


BAD = [(9001, None), (9002, [None] * 12), (9003, [float("nan")] * 12), (9004, [])]


def _exact(v, q, k):
    s = np.round(v[q] @ v.T, 6) + 0.0
    return [(i, float(s[i])) for i in sorted((i for i in range(len(v)) if i != q), key=lambda i: (-s[i], i))[:k]]


def test_blocks_give_the_exact_best(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 9)
    rows = _frame(spark, vectors, BAD)
    asked = rows.where("id % 30 = 0 OR id > 9000").selectExpr("id AS query", "v AS q")
    got = {}
    for r in vector_search.knn(asked, rows, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    assert set(got) == set(range(0, 600, 30))
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in _exact(vectors, q, 5)] and np.allclose([s for _, s in found], [s for _, s in _exact(vectors, q, 5)])
    assert vector_search.knn(asked.limit(0), rows, 5).count() == 0 and vector_search.knn(asked, rows.limit(0), 5).count() == 0


def test_probes_come_by_their_cost():
    margins = np.array([0.5, -0.1, 0.9, -2.0])
    found = probes(margins, 16)
    own = found[0]
    cost = [sum(margins[b] ** 2 for b in range(4) if (own ^ p) >> b & 1) for p in found]
    assert own == 0b0101 and sorted(found) == list(range(16)) and cost == sorted(cost) and probes(margins, 3) == found[:3]


def test_an_index_on_disk(spark, vectors):
    hot = [(1000 + i, [float(x) for x in vectors[0]]) for i in range(300)]
    rows = _frame(spark, vectors, [*hot, *BAD])
    asked = rows.where("id < 600 AND id % 20 = 0").selectExpr("id AS query", "v AS q")
    exact = vector_search.knn(asked, rows, 10)
    index = HyperplaneIndex.build(rows, f"{shared_dir(spark)}/lodestone/test-planes", bits=5)
    again = HyperplaneIndex.load(spark, index.path)
    assert again.rows.count() == 900 and np.array_equal(again.normals, index.normals)
    everything = again.search(asked, 10, share=1.0)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))
    shares = [(again.read_share(asked, s), vector_search.recall(again.search(asked, 10, s), exact)) for s in (0.1, 0.4, 0.7)]
    assert shares[0][0] < shares[1][0] < shares[2][0] < 1 and shares[0][1] <= shares[1][1] <= shares[2][1] and shares[2][1] >= 0.9
    assert again.search(asked, 10, 1.0, where="id < 50").where("id >= 50").count() == 0
    assert HyperplaneIndex.build(rows.limit(0), f"{shared_dir(spark)}/lodestone/test-empty", bits=3).search(asked, 5).count() == 0


def test_losses_by_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 70)
    rows = _frame(spark, vectors)
    asked = rows.where("id % 100 = 0").selectExpr("id AS query", "v AS q", "id + 1 AS positive_id")
    s = np.round(vectors @ vectors.T, 6)
    loss, lost, ranks = {}, [], {}
    for q in range(0, 600, 100):
        t = {i: s[q, i] / 0.1 for i in range(600) if i != q}
        top = max(t.values())
        loss[q] = math.log(sum(math.exp(x - top) for x in t.values())) + top - t[q + 1]
        negatives = [i for i in t if i != q + 1]
        lost += [max(0.0, 1.0 - s[q, q + 1] + s[q, i]) for i in negatives]
        ranks[q] = 1 + sum(s[q, i] >= s[q, q + 1] for i in negatives)
    got = {r["query"]: r["loss"] for r in vector_search.infonce(asked, rows, 0.1).collect()}
    assert got.keys() == loss.keys() and all(abs(got[q] - loss[q]) < 2e-6 for q in loss)
    pairs = asked.crossJoin(rows).where("id <> query").selectExpr("query", "q", "v", "id = positive_id AS is_positive")
    again = {r["query"]: r["loss"] for r in vector_search.infonce_of_slices(pairs.repartition(7), 0.1).collect()}
    assert again.keys() == loss.keys() and all(abs(again[q] - loss[q]) < 2e-6 for q in loss)
    assert abs(vector_search.margin_loss(asked, rows).first()["loss"] - np.mean(lost)) < 2e-6
    assert {r["query"]: r["rank"] for r in vector_search.positive_ranks(asked, rows).collect()} == ranks


def test_hybrid_search_of_many_queries(spark):
    edges = spark.createDataFrame([(i, i + 1, "NEXT") for i in range(20)], "src int, dst int, edge_type string")
    primary = spark.createDataFrame([(1, 3), (1, 4), (2, 15)], "query int, id int")
    found = sorted((r["query"], r["role"], r["hop"], r["id"]) for r in search.hybrid(primary, edges, 2, 5).collect())
    assert found == [(1, "context", 1, 2), (1, "context", 1, 5), (1, "context", 2, 1), (1, "primary", 0, 3), (1, "primary", 0, 4), (2, "context", 1, 14), (2, "context", 1, 16), (2, "context", 2, 13), (2, "context", 2, 17), (2, "primary", 0, 15)]


def _plain(text, dimensions):
    """The embedder token by token."""
    out = np.zeros(dimensions)
    for token in re.findall("[A-Za-z_][A-Za-z0-9_]*|[0-9]+", text):
        h = sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(token.lower().encode())) + len(token)
        h %= 1 << 64
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h ^= h >> 31
        out[h % dimensions] += 1.0 if h >> 63 else -1.0
    size = np.linalg.norm(out)
    return out / size if size else out


TEXTS = ["int main_1(void) { return 12abc; }", "", None, "é ö 日本", "A_b a_B 9 99", "x" * 5000, "word other\n" * 700, "  12", "7up _x"]


def test_the_embedder_is_its_plain_form():
    flat = pa.array([t or "" for t in TEXTS])
    assert np.allclose(chunk_vectors(flat, 32), [_plain(t or "", 32) for t in TEXTS])
    assert np.allclose(chunk_vectors(flat.slice(4, 3), 32), [_plain(t or "", 32) for t in TEXTS[4:7]])


def test_long_texts_are_means_of_their_chunks(spark):
    from lodestone.functions.chunking import pieces

    found = embedded(pa.array(TEXTS), 16, 400, 50)
    for text, own in zip(TEXTS, found, strict=True):
        chunks = pieces(pa.array([text], pa.string()), 400, 50).to_pylist()[0]
        mean = np.mean([_plain(c, 16) for c in chunks], axis=0) if chunks else np.zeros(16)
        size = np.linalg.norm(mean)
        assert np.allclose(own, mean / size if size else mean)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", embedder(16, 100, 12)("t").alias("v")).orderBy("i").collect()
    assert np.allclose([r["v"] for r in rows], embedded(pa.array(TEXTS), 16, 400, 48), atol=1e-6)
    assert embedded(pa.array([], pa.string()), 16, 400, 50).shape == (0, 16)


def test_blocks_meet_in_many_tasks(spark, vectors, monkeypatch):
    """Keys of both sides have one type: with several tasks an int and a long of one value lie apart, and nothing was found."""
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(vector_search, "SLICE", 200)
    rows = _frame(spark, vectors)
    asked = rows.where("id % 30 = 0").selectExpr("id AS query", "v AS q")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["query"], r["rank"]): r["id"] for r in vector_search.knn(asked, rows, 5).collect()}
        index = HyperplaneIndex.build(rows, f"{shared_dir(spark)}/lodestone/test-tasks", bits=2)
        near = {(r["query"], r["rank"]): r["id"] for r in index.search(asked, 5, share=1.0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(q, n + 1): i for q in range(0, 600, 30) for n, (i, _) in enumerate(_exact(vectors, q, 5))}
    assert got == want and near == want


def test_products_round_as_a_sum_in_order_does():
    rng = np.random.default_rng(4)
    q, v = np.round(rng.standard_normal((40, 7)), 1), np.round(rng.standard_normal((300, 7)), 1)
    got = vector_search.products(q, v, 1)
    for i in range(40):
        for j in range(300):
            x = 0.0
            for a, b in zip(q[i].tolist(), v[j].tolist(), strict=True):
                x += a * b
            assert got[i, j] == math.copysign(math.floor(abs(x * 10) + 0.5), x) / 10


def test_a_batch_is_embedded_in_runs(monkeypatch):
    from lodestone.functions import embedding

    texts = pa.array(["one two three " * 40, None, "", "x" * 5000, "four five"] * 7)
    whole = embedded(texts, 16, 200, 20)
    most = []

    def watched(chunks, dimensions):
        most.append(len(chunks))
        return chunk_vectors(chunks, dimensions)

    monkeypatch.setattr(embedding, "CHUNKS", 3)
    monkeypatch.setattr(embedding, "RUN", 700)
    parts = embedding.runs(texts)
    assert sum(map(len, parts)) == len(texts) and len(parts) > 5
    assert np.array_equal(whole, np.concatenate([embedded(t, 16, 200, 20, watched) for t in parts])) and max(most) == 3


def test_equal_questions_and_codes_are_searched_once(spark, monkeypatch):
    """Paths whose questions have one vector share a search, and of equal codes only those that can be found are embedded; the hits stay those of the whole search."""
    from pyspark.sql import functions as F

    from lodestone.operators import paths

    embed = embedder(16)
    names = [f"{a} {b}" for a in ("page", "red", "show", "kernel") for b in ("read", "ring", "x")]
    nodes = spark.createDataFrame([(i, names[i * 7 % 12], f"f{i}.c") for i in range(300)], "id long, code string, file_path string")
    codes = vector_search.first_of_equals(nodes.select("id", "code"), ["code"], 5)
    assert sorted(r["id"] for r in codes.collect()) == list(range(72))
    asked = spark.createDataFrame([(f"/sys/kernel/mm/page_{i}",) for i in range(60)] + [("",)], "path string").select("path", paths.scan_query(F.col("path")).alias("question"))
    everything = HyperplaneIndex.build(nodes.select("id", embed("code").alias("v")), f"{shared_dir(spark)}/lodestone/test-all", bits=3)
    number = (-F.xxhash64("path")).alias("query")
    plain = everything.search(asked.select(number, embed("question").alias("q")), 5, 0.7).join(asked.select(number, "path"), "query").join(nodes.select("id", "file_path"), "id")
    few = HyperplaneIndex.build(codes.select("id", embed("code").alias("v")), f"{shared_dir(spark)}/lodestone/test-few", bits=3)
    searched, search_of = [], HyperplaneIndex.search
    monkeypatch.setattr(HyperplaneIndex, "search", lambda self, queries, *a, **b: searched.append(queries.count()) or search_of(self, queries, *a, **b))
    found = paths.nearest(asked, few, embed, 5, 0.7, nodes.select("id", "file_path"))
    columns = ["path", "rank", "id", "score", "file_path"]
    assert sorted(found.select(columns).collect()) == sorted(plain.select(columns).collect()) and found.count() == 61 * 5
    assert searched == [asked.select(embed("question").alias("q")).distinct().count()] and searched[0] <= 33


def test_a_path_with_a_rule_is_not_searched(spark, monkeypatch):
    from lodestone.operators import paths
    from lodestone.plans import workflows

    asked, nearest_of = [], paths.nearest
    monkeypatch.setattr(paths, "nearest", lambda questions, *a, **b: asked.append(questions) or nearest_of(questions, *a, **b))
    found = workflows.path_scan_vectors(spark, "/root/testdata/sf0.001")
    level = {r["path"]: r["confidence"] for r in found.collect()}
    assert {r["path"] for r in asked[0].collect()} == {p for p, c in level.items() if c == "medium"} and set(level.values()) == {"high", "medium"}


def test_handlers_of_equal_questions_are_searched_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone.functions.text import query_text
    from lodestone.operators import paths

    embed = embedder(16)
    names = [f"{a} {b}" for a in ("page", "red", "show", "kernel") for b in ("read", "ring", "x")]
    nodes = spark.createDataFrame([(i, names[i * 7 % 12], "function" if i % 5 < 2 else "struct") for i in range(300)], "id long, code string, node_type string")
    codes = vector_search.first_of_equals(nodes, ["code", "node_type"], 5)
    kept = {(r["code"], r["node_type"], r["id"]) for r in codes.collect()}
    assert len(kept) == 12 * 2 * 6 and kept == {(c, t, i) for c in names for t in ("function", "struct") for i in sorted(r["id"] for r in nodes.where(f"code = '{c}' AND node_type = '{t}'").collect())[:6]}
    asked = spark.createDataFrame([(f"/proc/{i}/maps",) for i in range(60)] + [("/proc/1/maps ",)], "path string")
    everything = HyperplaneIndex.build(nodes.select("id", embed("code").alias("v"), "node_type"), f"{shared_dir(spark)}/lodestone/test-all-handlers", bits=3)
    trimmed, number = asked.select(F.trim("path").alias("path")).distinct(), F.xxhash64("path").alias("query")
    plain = everything.search(trimmed.select(number, embed(query_text(paths.handler_query(F.col("path")))).alias("q")), 5, 0.7, where="node_type = 'function'").join(trimmed.select(number, "path"), "query")
    few = HyperplaneIndex.build(codes.select("id", embed("code").alias("v"), "node_type"), f"{shared_dir(spark)}/lodestone/test-few-handlers", bits=3)
    searched, search_of = [], HyperplaneIndex.search
    monkeypatch.setattr(HyperplaneIndex, "search", lambda self, queries, *a, **b: searched.append(queries.count()) or search_of(self, queries, *a, **b))
    found = paths.handler_hits(asked, few, embed, 5, 0.7)
    columns = ["path", "rank", "id", "score"]
    assert sorted(found.collect()) == sorted(plain.select(columns).collect()) and found.count() == 60 * 5 and searched[0] <= 33


def _rows_of(names, vectors, k=5):
    return vector_search._Side(np.array(names, np.int64), np.array(vectors), k)


def _best(side):
    found = {int(n): [] for n in side.names}
    for q, i, s in zip(*(side.found()[c].to_pylist() for c in ("query", "id", "score")), strict=True):
        found[q].append((i, s))
    return found


def _plain_best(own, other, k):
    s = vector_search.products(own.v.astype(np.float64), other.v.astype(np.float64), 6)
    s[own.names[:, None] == other.names[None, :]] = -np.inf
    order = {int(n): np.lexsort((other.names, -s[i])) for i, n in enumerate(own.names)}
    return {n: [(int(other.names[j]), s[i, j]) for j in order[n][:k] if s[i, j] > -np.inf] for i, n in enumerate(own.names.tolist())}


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_blocks_that_meet_once_give_the_best_of_both(kind, monkeypatch):
    rng = np.random.default_rng(5)
    plain = rng.standard_normal((500, 8)).astype(kind)
    copies = plain.copy()
    copies[50:300] = copies[7]
    close = (np.repeat(plain[:5], 60, axis=0) + rng.standard_normal((300, 8)) * 1e-7).astype(kind)
    sets = [(plain, plain[::-1][:333]), (copies, copies[::-1]), (close, close[::-1]), (np.round(plain), np.round(plain[:90])), (plain[:2], plain[:1]), ((plain * 1e16).astype(kind), plain), (plain * 0, plain)]
    for tiles in ((7, 48), (512, 1024)):
        monkeypatch.setattr(vector_search, "TILE_QUERIES", tiles[0])
        monkeypatch.setattr(vector_search, "TILE_ROWS", tiles[1])
        for v, w in sets:
            for k in (1, 5):
                a, b = _rows_of(rng.permutation(len(v)), v, k), _rows_of(rng.permutation(len(w)) + len(v), w, k)
                vector_search._meet(a, b, 6, both=True)
                assert _best(a) == _plain_best(a, b, k) and _best(b) == _plain_best(b, a, k)
                a = _rows_of(rng.permutation(len(v)), v, k)
                vector_search._meet(a, vector_search._Side(a.names, a.v, k), 6)
                assert _best(a) == _plain_best(a, a, k)


def test_few_products_are_rounded(monkeypatch):
    """Rough products leave out what can't be among the best; before, each pair was rounded."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((4000, 16)).astype(np.float32)
    rounded, plainly = [], vector_search._rounded
    monkeypatch.setattr(vector_search, "_rounded", lambda rough, *a: rounded.append(rough.size) or plainly(rough, *a))
    table = pa.table({"id": np.arange(4000), "v": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 16).cast(pa.list_(pa.float32()))})
    found = vector_search._nearest(5, 6, itself=True)(table, table.slice(0, 0))
    assert found.num_rows == 20_000 and sum(rounded) < 0.02 * 4000**2


def test_nearest_of_all_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_search, "LEAST_ROWS", 100)
    rows = _frame(spark, vectors, BAD)
    got = {}
    for r in vector_search.knn_of_all(rows, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got == {q: [i for i, _ in _exact(vectors, q, 5)] for q in range(600)}
    assert vector_search.knn_of_all(rows.limit(0), 5).count() == 0


def test_walks_end_with_their_nodes(spark, monkeypatch):
    """A query walks no further than its nodes need: a node with many neighbours isn't a row for each of them and query."""
    from lodestone.operators import graph

    hub = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400)] + [(500, 501), (501, 502), (502, 503)]
    edges = spark.createDataFrame([(*e, "NEAR") for e in hub], "src int, dst int, edge_type string")
    seeds = spark.createDataFrame([(q, 0) for q in range(20)] + [(30, 500), (31, 1005), (32, 7)], "query int, id int")
    sizes, plainly = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (sizes.append((name, (out := plainly(df, name)).count())), out)[1])
    got = {}
    for r in graph.neighborhoods(edges, seeds, 2, 6).collect():
        got.setdefault(r["query"], set()).add((r["id"], r["hop"]))
    assert all(got[q] == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)} for q in range(20))
    assert got[30] == {(500, 0), (501, 1), (502, 2)} and got[31] == {(1005, 0), (5, 1), (0, 2)} and got[32] == {(7, 0), (0, 1), (1007, 1), (1, 2), (2, 2), (3, 2)}
    assert sum(n for name, n in sizes if name == "frontiers") < 300
