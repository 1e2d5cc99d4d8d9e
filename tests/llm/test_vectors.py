import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, exact_topk
from lodestone.llm.ann import Graph, ann_topk

SCHEMA = "vec_id long, embedding array<float>, label int, v double, rank int, score double"


def _rows(n, d=16, seed=1, scale=0.3):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, scale, (n, d)).astype(np.float32)
    m[: n // 3] = m[0]  # one vector is a third of all
    return m


def _table(spark, m, extra=()):
    rows = [(i, [float(x) for x in r], 0, None, 7, 0.5) for i, r in enumerate(m)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


ODD = [
    (None, [0.5] * 16, 0, None, 1, None),
    (5000, None, 0, None, 1, None),
    (5050, [], None, None, 1, None),
    (5100, [float("nan")] * 16, 0, None, 1, None),
    (5150, [float("inf")] + [0.0] * 15, 0, None, 1, None),
    (5200, [None] + [0.1] * 15, 0, None, 1, None),
]


def _exact(m, every, k):
    g = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    out = []
    for q in range(0, len(g), every):
        s = g @ g[q]
        ids = np.array([i for i in range(len(g)) if i != q])
        best = ids[np.lexsort((ids, -s[ids]))[:k]]
        out += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_exact_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "HEAD", 8 if block == 16 else 2048)
    m = _rows(150)
    m[::7] *= 3
    got = exact_topk.exact_topk(_table(spark, m, ODD), 5, 50)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == _exact(m, 50, 5)


def test_exact_topk_repeats_and_few_rows(spark):
    m = _rows(3)
    rows = _table(spark, m)
    got = exact_topk.exact_topk(rows.union(rows), 5, 1)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == _exact(m, 1, 5)
    assert exact_topk.exact_topk(rows.limit(0)).count() == 0 and exact_topk.exact_topk(rows.limit(1)).count() == 0


def test_large_components_are_exact():
    big = np.array([[2.0**40, 1.0], [3.0, 2.0**30]])
    assert exact_topk.products(big, np.array([[2.0**20, 5.0]])).tolist() == [[2**60 + 5], [3 * 2**20 + 5 * 2**30]]


def _nearest(m, every, k):
    m = m.astype(np.float64)
    out = {}
    for q in range(0, len(m), every):
        s = (m * m[q]).sum(1)
        ids = np.array([i for i in range(len(m)) if i != q])
        best = ids[np.lexsort((ids, -s[ids]))[:k]]
        out[q] = {int(i): float(s[i]) for i in best}
    return out


def test_ann_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "LIST_ROWS", 40)
    monkeypatch.setattr(ann, "PART_ROWS", 90)  # some lists have several parts
    m = _rows(1500, seed=4)
    got = ann_topk(_table(spark, m, [*ODD, (6000, [0.0] * 16, 0, None, 1, None)]), 20, 20).collect()
    want = _nearest(m, 20, 20)
    hits = 0
    for q, near in want.items():
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(own) == 20 and [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - float((m[r["vec_id"]].astype(float) * m[q].astype(float)).sum())) < 1e-9 for r in own)
        hits += len({r["vec_id"] for r in own} & near.keys())
    assert {r["query_id"] for r in got} == set(want) and hits >= 0.9 * 20 * len(want)


def test_the_walk_opens_a_part_of_the_graph():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 6
    c = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16))
    graph = Graph(c)
    p = c[:200] + rng.normal(size=(200, 16)) * 0.1
    which, dist = graph.search(p, 32)
    assert graph.visited < 0.5 * len(c) * len(p)
    true = np.sqrt(((p[:, None, :] - c[None, :, :]) ** 2).sum(2))
    assert np.allclose(dist, np.take_along_axis(true, which, axis=1)) and (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(row)) == 32 for row in which.tolist())
    assert (true.argmin(axis=1) == which[:, 0]).mean() > 0.95


def test_ann_copies_of_one_vector(spark, monkeypatch):
    """A third of all rows is one vector: its list has several parts, and all of them count."""
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK", 32)
    m = _rows(900, seed=6)
    m[:300] = m[0]
    got = ann_topk(_table(spark, m, []), 20, 100).collect()
    for q in (0, 100, 200):
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [v for _, v in own] == [i for i in range(21) if i != q][:20]


def test_ann_small_tables(spark):
    rows = _table(spark, _rows(6))
    assert ann_topk(rows, 20, 2).count() == 3 * 5
    assert ann_topk(rows.limit(0)).count() == 0


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(6)
    g = Graph(rng.normal(0, 1, (600, 8)))
    p = rng.normal(0, 1, (40, 8))
    which, dist = g.search(p, 16)
    true = np.argsort(((p[:, None] - g.c[None]) ** 2).sum(2), axis=1)[:, :16]
    assert np.mean([len(set(a) & set(b)) / 16 for a, b in zip(which, true, strict=True)]) > 0.95
    assert np.allclose(dist, np.sqrt(((p[:, None] - g.c[which]) ** 2).sum(2)))


def test_a_null_column_of_vectors(spark):
    rows = spark.range(3).select(F.col("id").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"))
    assert ann_topk(rows).count() == 0 and exact_topk.exact_topk(rows).count() == 0


def test_ann_fits_its_ratio_to_the_rows_that_ask(spark):
    """Most rows are near copies that find each other in one list; the queries are none of them and need many lists."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(6000, 32))
    easy = np.arange(6000) % 20 > 4
    m[easy] = rng.normal(size=(15, 32))[rng.integers(0, 15, easy.sum())] + 0.001 * rng.normal(size=(easy.sum(), 32))
    m = m.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann_topk(rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, 6000, 20):
        score = m @ m[q]
        score[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.93
