"""Vector search, hybrid retrieval, reranking and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot
from lodestone.operators.graph import neighborhoods


def node_filter(node_type: str | None = None, path: str | None = None, prefix: bool = False) -> Column:
    """Equality on node_type, and a substring (or prefix) of file_path."""
    found = F.lit(True)
    if node_type is not None:
        found = found & (F.col("node_type") == node_type)
    if path is not None:
        found = found & (F.col("file_path").startswith(path) if prefix else F.col("file_path").contains(path))
    return found


def pooled(chunks: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    """The mean of each key's vectors at length 1 (left as it is if 0)."""
    mean = chunks.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    gathered = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    size = F.sqrt(dot(F.col("m"), F.col("m")))
    return gathered.withColumn("size", size).select(key, F.transform("m", lambda x: F.when(F.col("size") == 0, x).otherwise(x / F.when(F.col("size") != 0, F.col("size")))).alias("v"))


def hybrid(primary: DataFrame, edges: DataFrame, hops: int, max_nodes: int = 30) -> DataFrame:
    """query, id, role, hop: each query's primary hits (query, id) and what lies around them in the graph, no id twice.

    Of a query's nodes the ``max_nodes`` nearest stay, by steps and id.
    """
    around = neighborhoods(edges, primary, hops, max_nodes)
    context = around.join(primary, ["query", "id"], "left_anti").select("query", "id", F.lit("context").alias("role"), "hop")
    return primary.select("query", "id", F.lit("primary").alias("role"), F.lit(0).alias("hop")).union(context)


def rule_rerank(candidates: DataFrame, weights: dict[str, float], default: float, k: int) -> DataFrame:
    """query, rank, id, score: score x weight of the node's type x (1 + 0.1 min(1, docstring / 200)); unknown nodes keep theirs.

    ``candidates``: query, id, score, node_type, doc_length (null for unknown nodes).
    """
    weight = F.lit(default)
    for name, w in weights.items():
        weight = F.when(F.col("node_type") == name, F.lit(w)).otherwise(weight)
    bonus = F.lit(1.0) + F.lit(0.1) * F.least(F.lit(1.0), F.col("doc_length") / F.lit(200.0))
    new = F.when(F.col("node_type").isNull(), F.col("score")).otherwise(F.col("score") * weight * bonus)
    scored = candidates.select("query", "id", F.round(new, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def within_budget(ranked: DataFrame, budget: int, by: str = "query", order: str = "rank", size: str = "size") -> DataFrame:
    """The longest prefix of each ranked list whose sizes fit the budget; the first row always stays."""
    running = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", running).where((F.col("running") <= budget) | (F.col(order) == 1))


def first_rule(rows: DataFrame, rules: list[tuple[int, str, str]], column: str) -> DataFrame:
    """The first rule (order, pattern, name) whose pattern matches all of a column; rules are a bounded parameter."""
    found = F.lit(None).cast("string")
    for _, pattern, name in sorted(rules, reverse=True):
        found = F.when(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return rows.withColumn("rule", found)
