"""Distributed ranks, and negatives drawn by number."""

from collections import Counter, defaultdict

from lodestone.operators import asof, bm25, proposals, traindata
from lodestone.operators.ranking import numbered, running


def test_numbers_and_sums_of_one_key_of_all_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.lit("same").alias("key"), (F.col("id") * 7919 % 5003).alias("x"), (F.col("id") % 3).alias("w"))
    placed = numbered(rows, ["key", "x"]).orderBy("x").collect()
    assert [r["position"] for r in placed] == list(range(5000))
    summed, total = running(rows, ["x"], F.col("w")).orderBy("x").collect(), 0
    for r in summed:
        assert r["before"] == total
        total += r["w"]
    assert running(rows.limit(0), ["x"], F.col("w")).count() == 0


def test_upper_median_of_skewed_groups_and_nulls(spark):
    values = [("a", float(i % 97)) for i in range(3000)] + [("b", 2.0), ("b", None), ("b", 1.0), ("c", None), ("d", 5.0)]
    got = {r["g"]: r["upper_median"] for r in asof.upper_median(spark.createDataFrame(values, "g string, v double"), "v", ["g"]).collect()}
    by = defaultdict(list)
    for g, v in values:
        if v is not None:
            by[g].append(v)
    assert got == {g: sorted(v)[len(v) // 2] for g, v in by.items()}


def test_difficulty_and_stack(spark):
    gaps = [(f"q{i}", round(i % 5 / 2, 6)) for i in range(40)]
    got = {r["query"]: r["difficulty"] for r in bm25.difficulty_rank(spark.createDataFrame(gaps, "query string, gap double")).collect()}
    assert got == {q: round(1 - sum(h < g for _, h in gaps) / 39, 6) for q, g in gaps}
    pushes = [(1, "a"), (2, None), (3, "b"), (4, "c"), (5, "b"), (6, "a")]
    stack = proposals.pending(spark.createDataFrame(pushes, "at int, id string")).collect()
    assert sorted((r["position"], r["id"]) for r in stack) == [(1, "b"), (2, "c"), (3, "a")]


def test_every_row_outside_the_group_can_be_drawn(spark):
    pool = [(i, "big" if i % 3 == 0 else f"g{i % 4}") for i in range(60)] + [(100, None)]
    asked = [(f"q{i}", "big" if i % 2 else "g1") for i in range(400)] + [("alone", "none such")]
    positives = [(f"q{i}", i % 60) for i in range(400)] + [(f"q{i}", (i + 1) % 60) for i in range(400)]
    found = traindata.easy_negatives(spark.createDataFrame(asked, "query string, grp string"), spark.createDataFrame(pool, "id int, grp string"), 42, 8, spark.createDataFrame(positives, "query string, id int")).collect()
    group, wrong = dict(pool), defaultdict(set)
    for q, i in positives:
        wrong[q].add(i)
    by = defaultdict(list)
    for r in found:
        by[r["query"]].append(r["id"])
    assert set(by) == {q for q, _ in asked}
    for q, g in asked:
        assert len(by[q]) == len(set(by[q])) == 8 and not wrong[q] & set(by[q]) and all(group[i] != g for i in by[q])
    drawn = Counter(i for q, g in asked if g == "big" for i in by[q])
    assert set(drawn) == {i for i, g in pool if g != "big"}


def test_a_pool_that_is_too_small_gives_all_it_has(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, grp string")
    asked = spark.createDataFrame([("q", "a"), ("r", "b")], "query string, grp string")
    found = traindata.easy_negatives(asked, pool, 1, 8, spark.createDataFrame([("q", 4)], "query string, id int")).collect()
    assert sorted((r["query"], r["id"]) for r in found) == [("q", 3), ("r", 1), ("r", 2), ("r", 4)]
    assert traindata.easy_negatives(asked, pool.limit(0), 1, 8).count() == 0
