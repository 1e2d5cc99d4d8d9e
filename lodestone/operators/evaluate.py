"""Evaluation of retrieval: gold sets, arms, symbol recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import metrics


def gold_ids(gold: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """query, id: relevant ids of gold rows (query, relevant_ids, expected_symbols, expected_files).

    Given ids count as they are.  Otherwise an id 'file::symbol' counts if it exists, and so do the first ``most``
    nodes (id, symbol_name) of every symbol.  Files meet symbols inside a gold row only.
    """
    given = gold.where("relevant_ids IS NOT NULL").select("query", F.explode("relevant_ids").alias("id"))
    named = gold.where("relevant_ids IS NULL")
    pairs = named.select("query", F.explode("expected_symbols").alias("symbol_name"), "expected_files").select("query", "symbol_name", F.explode("expected_files").alias("file"))
    exact = pairs.select("query", F.concat_ws("::", "file", "symbol_name").alias("id")).join(nodes.select("id"), "id", "left_semi").select("query", "id")
    asked = named.select("query", F.explode("expected_symbols").alias("symbol_name")).distinct()
    own = nodes.join(asked.select("symbol_name").distinct(), "symbol_name", "left_semi")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("symbol_name").orderBy("id"))).where(F.col("r") <= most)
    return given.union(exact).union(asked.join(first, "symbol_name").select("query", "id")).distinct()


def baseline(found: DataFrame) -> DataFrame:
    """query, rank, doc of search results (query, rank, id, score)."""
    return found.select("query", "rank", F.col("id").alias("doc"))


def learned_rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """query, rank, id, score by a model's score of question and text; ``candidates``: query, question, id, text."""
    scored = candidates.select("query", "id", score(F.col("question"), F.col("text")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def compared(arms: dict[str, DataFrame], relevant: DataFrame, k: int = 10) -> DataFrame:
    """Means of the metrics for each arm (query, rank, doc)."""
    rows = None
    for name, found in sorted(arms.items()):
        own = metrics.ranking_metrics(found, relevant, k).withColumn("arm", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return metrics.arm_means(rows)


def symbol_metrics(found: DataFrame, expected: DataFrame) -> DataFrame:
    """query, recall, hit_at_1, rr over symbols: found (query, rank, symbol), expected (query, symbol)."""
    wanted = expected.distinct()
    n = wanted.groupBy("query").agg(F.count("*").alias("n"))
    hit = found.groupBy("query", "symbol").agg(F.min("rank").alias("rank")).join(wanted, ["query", "symbol"], "left_semi")
    per = hit.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    met = n.join(per, "query", "left")
    return met.select("query", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit_at_1"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def weakest(per_query: DataFrame, k: int = 5) -> DataFrame:
    """The k queries of the lowest recall."""
    return per_query.orderBy("recall", "query").limit(k)


def batch_recall(scores: DataFrame, k: int) -> DataFrame:
    """batch, recall: the share of a batch's queries whose positive is among its k best (batch, query, score, is_positive); ties rank behind, queries without a positive are left out."""
    best = scores.groupBy("batch", "query").agg(F.max(F.when(F.col("is_positive"), F.col("score"))).alias("own")).where("own IS NOT NULL")
    ahead = scores.join(best, ["batch", "query"]).groupBy("batch", "query").agg(F.sum((~F.col("is_positive") & (F.col("score") >= F.col("own"))).cast("int")).alias("ahead"))
    return ahead.groupBy("batch").agg(F.round(F.avg((F.col("ahead") < k).cast("double")), 6).alias("recall"))
