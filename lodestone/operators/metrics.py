"""Retrieval metrics over result tables; losses over vectors are in ``vector_search``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """query, ndcg_retrieved, ndcg, recall, mrr; queries without relevant ids are left out.

    ``results``: query, rank, doc; ``relevant``: query, doc.  ndcg_retrieved takes its
    ideal from what was retrieved, ndcg from all relevant ids.
    """
    hit = results.join(relevant.distinct().withColumn("rel", F.lit(1)), ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    count = relevant.distinct().groupBy("query").agg(F.count("*").alias("n_rel"))
    gain = lambda at: F.lit(1.0) / F.log2(at + F.lit(1.0))
    per = hit.groupBy("query").agg(
        F.coalesce(F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), gain(F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
    )
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i))
    out = count.join(per, "query", "left").fillna({"dcg": 0.0, "hits": 0})
    share = lambda n: F.when(n > 0, F.round(F.col("dcg") / ideal(n), digits)).otherwise(F.lit(0.0))
    return out.select(
        "query",
        share(F.col("hits")).alias("ndcg_retrieved"),
        share(F.least(F.col("n_rel"), F.lit(k))).alias("ndcg"),
        F.round(F.col("hits") / F.greatest(F.col("n_rel"), F.lit(1)), digits).alias("recall"),
        F.coalesce(F.round(F.lit(1.0) / F.col("first"), digits), F.lit(0.0)).alias("mrr"),
    )


def arm_means(metrics: DataFrame) -> DataFrame:
    """Means of the metrics for each arm."""
    names = [c for c in metrics.columns if c not in ("arm", "query")]
    return metrics.groupBy("arm").agg(*(F.round(F.avg(c), 6).alias(c) for c in names), F.count("*").alias("n_queries"))


def mean_deviation(values: DataFrame, value: str) -> DataFrame:
    return values.agg(F.round(F.avg(value), 6).alias("mean"), F.coalesce(F.round(F.stddev_samp(value), 6), F.lit(0.0)).alias("deviation"))
