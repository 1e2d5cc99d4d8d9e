"""Typed property graphs as tables: nodes, edges and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written


def reference_edges(nodes: DataFrame, refs: str, edge_type: str) -> DataFrame:
    """An edge from a node to every node whose symbol its array ``refs`` names, but not to itself."""
    named = nodes.select(F.col("id").alias("src"), F.explode(refs).alias("symbol"))
    targets = nodes.select(F.col("id").alias("dst"), F.col("symbol_name").alias("symbol"))
    return named.join(targets, "symbol").where("src <> dst").select("src", "dst", F.lit(edge_type).alias("edge_type"))


def two_ends(rows: DataFrame, by: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) two rows of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) if last else F.asc(c) for c in order)))
    return rows.withColumn("_rank", rank).where("_rank <= 2")


def reference_summary(nodes: DataFrame, refs: str) -> DataFrame:
    """src, n, first, last: how many edges ``reference_edges`` gives a node, and their least and greatest targets.

    No edge is laid out: a symbol has a number of definitions and two ids at either end, of which one isn't the node's own.
    """
    own = nodes.where("id IS NOT NULL AND symbol_name IS NOT NULL").groupBy(F.col("symbol_name").alias("symbol"), "id").agg(F.count("*").alias("own"))
    own = written(own, "definitions")
    ends = own.groupBy("symbol").agg(F.sum("own").alias("all"))
    for name, last in (("low", False), ("high", True)):
        pair = two_ends(own, "symbol", ["id"], last).groupBy("symbol").agg(F.max(F.when(F.col("_rank") == 1, F.col("id"))).alias(name), F.max(F.when(F.col("_rank") == 2, F.col("id"))).alias(f"{name}_2"))
        ends = ends.join(pair, "symbol")
    # Written, so that its size is known where it meets the references: a row a symbol.
    ends = written(ends, "symbols")
    named = nodes.where("id IS NOT NULL").select(F.col("id").alias("src"), F.explode(refs).alias("symbol"))
    met = named.join(ends, "symbol").join(own.withColumnRenamed("id", "src"), ["symbol", "src"], "left")
    other = lambda name: F.when(F.col(name) == F.col("src"), F.col(f"{name}_2")).otherwise(F.col(name))
    n = F.sum(F.col("all") - F.coalesce("own", F.lit(0)))
    return met.groupBy("src").agg(n.alias("n"), F.min(other("low")).alias("first"), F.max(other("high")).alias("last")).where("n > 0")


def defined_in(nodes: DataFrame) -> DataFrame:
    """From every node to the file node of its path."""
    files = nodes.where("node_type = 'file'").select(F.col("id").alias("dst"), "file_path")
    return nodes.where("node_type <> 'file'").select(F.col("id").alias("src"), "file_path").join(files, "file_path").select("src", "dst", F.lit("DEFINED_IN").alias("edge_type"))


def path_suffixes(path: Column) -> Column:
    """All trailing parts of a path, the whole of it too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_join(refs: DataFrame, files: DataFrame, order: str = "id") -> DataFrame:
    """refs (src, ref, ordinal) x files (id, file_path): the first other file, by ``order``, whose path ends in ref.

    The suffix test is an equi-join: every path is exploded to its suffixes.  Of a suffix only the first two
    files are met, one of which is another; so a suffix of very many paths and references costs no product of them.
    """
    spread = files.where("id IS NOT NULL").select(F.col("id").alias("dst"), F.col(order).alias("_order"), F.explode(path_suffixes(F.col("file_path"))).alias("ref"))
    built = two_ends(spread.groupBy("ref", "dst").agg(F.min(F.struct("_order")).alias("s")).select("ref", "dst", "s._order"), "ref", ["_order", "dst"]).drop("_rank")
    met = refs.join(built, "ref").where("src <> dst")
    best = met.groupBy("src", "ordinal", "ref").agg(F.min_by("dst", F.struct("_order", "dst")).alias("dst"))
    return best.select("src", "ordinal", "ref", "dst")


def include_edges(nodes: DataFrame) -> DataFrame:
    """INCLUDES edges of nodes by path suffix, one per reference."""
    refs = nodes.select(F.col("id").alias("src"), F.posexplode("includes").alias("ordinal", "ref"))
    files = nodes.where("node_type = 'file'").select("id", "file_path")
    return suffix_join(refs, files).select("src", "dst", F.lit("INCLUDES").alias("edge_type"))


def resolve_edges(nodes: DataFrame) -> DataFrame:
    """All edges of a table of nodes; computed anew each time, so always complete."""
    calls = reference_edges(nodes, "calls", "CALLS")
    uses = reference_edges(nodes, "uses_structs", "USES_STRUCT")
    return calls.unionByName(uses).unionByName(defined_in(nodes)).unionByName(include_edges(nodes))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: in and out, parallel edges counted, a loop twice."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int, edge_types: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """id, hop: nodes within ``hops`` steps of the seeds (id), either way along edges; at most ``max_nodes``, nearest first.

    One join for each hop; what was reached before is left out of the next frontier.  Every
    frontier is written, so the plan of a hop doesn't hold those before it.
    """
    used = edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types))
    both = used.select("src", "dst").union(used.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached = frontier = written(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "frontier")
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(reached, "id", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached if max_nodes is None else reached.orderBy("hop", "id").limit(max_nodes)


def neighborhoods(edges: DataFrame, seeds: DataFrame, hops: int, max_nodes: int | None = None) -> DataFrame:
    """query, id, hop: for every query its own nodes within ``hops`` steps of its seeds (query, id), nearest first, at most ``max_nodes`` each.

    All queries walk together, one join a hop; every frontier is written.  A query that has its ``max_nodes``
    walks no further: whatever it would reach lies behind them.  So of a node's neighbours the ``max_nodes`` of the
    smallest ids are enough: with more than those a query has its nodes.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if max_nodes is not None:
        nth = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        both = written(both.withColumn("_n", nth).where(F.col("_n") <= max_nodes).drop("_n"), "steps")
    reached = frontier = written(seeds.select("query", "id").distinct().withColumn("hop", F.lit(0)), "frontiers")
    for hop in range(1, hops + 1):
        if max_nodes is not None:
            done = reached.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= max_nodes)
            frontier = frontier.join(done, "query", "left_anti")
        step = both.join(frontier.select("query", F.col("id").alias("src")), "src").select("query", F.col("dst").alias("id")).distinct()
        frontier = written(step.join(reached, ["query", "id"], "left_anti").withColumn("hop", F.lit(hop)), "frontiers")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    if max_nodes is None:
        return reached
    rank = F.row_number().over(Window.partitionBy("query").orderBy("hop", "id"))
    return reached.withColumn("_rank", rank).where(F.col("_rank") <= max_nodes).drop("_rank")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id)."""
    own = ids.select("id")
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def into(edges: DataFrame, nodes: DataFrame, edge_type: str, symbol: str, distinct: bool = False) -> DataFrame:
    """Nodes with an edge of the type to any definition of the symbol, once for each definition."""
    targets = nodes.where(F.col("symbol_name") == symbol).select(F.col("id").alias("dst"))
    found = edges.where(F.col("edge_type") == edge_type).join(targets, "dst").select(F.col("src").alias("id"))
    found = found.join(nodes, "id")
    return found.distinct() if distinct else found


def callers_of(edges: DataFrame, nodes: DataFrame, symbol: str) -> DataFrame:
    return into(edges, nodes, "CALLS", symbol)


def struct_users(edges: DataFrame, nodes: DataFrame, symbol: str) -> DataFrame:
    return into(edges, nodes, "USES_STRUCT", symbol)


def callees_of(edges: DataFrame, nodes: DataFrame, symbol: str) -> DataFrame:
    own = nodes.where(F.col("symbol_name") == symbol).select(F.col("id").alias("src"))
    return edges.where("edge_type = 'CALLS'").join(own, "src").select(F.col("dst").alias("id")).join(nodes, "id")


def subsystem_summary(nodes: DataFrame) -> DataFrame:
    """subsystem, node_type, n over source nodes."""
    return nodes.groupBy(F.get(F.split("file_path", "/"), 0).alias("subsystem"), "node_type").agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """Old rows but those that new ones replace; of new rows with one key the last by ``order``."""
    last = new.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_rank = 1").drop("_rank")
    return old.join(last.select(key), key, "left_anti").select(old.columns).unionByName(last.select(old.columns))


def saved(nodes: DataFrame, edges: DataFrame, layer: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes of a layer and the edges inside it."""
    own = nodes.where(F.col("layer") == layer)
    return own, induced(edges, own)


# --- layers: source -> binary -> live ------------------------------------------


def link_binary(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """SOURCE_TO_BINARY: nodes of a symbol kind x symbols (name, addr_start), one target for each name and start."""
    kinds = ["function", "struct", "union", "enum", "macro"]
    own = symbols.select("name", "addr_start").distinct()
    met = nodes.where(F.col("node_type").isin(kinds)).join(own, nodes["symbol_name"] == own["name"])
    return met.select(F.col("id").alias("src"), F.concat_ws("@", "name", F.col("addr_start").cast("string")).alias("dst"), F.lit("SOURCE_TO_BINARY").alias("edge_type"))


def link_live(binary: DataFrame, live: DataFrame, slide: int) -> DataFrame:
    """BINARY_TO_LIVE: every binary symbol's live address, verified if some entry of its name is there."""
    at = binary.withColumn("live_addr", (F.col("addr_start") + F.lit(slide).cast("decimal(21,0)")).cast("decimal(20,0)"))
    there = live.select("name", F.col("address").alias("live_addr"), F.lit(True).alias("verified")).distinct()
    return at.join(there, ["name", "live_addr"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def link_fields(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """FIELD_TO_OFFSET: struct nodes x struct_fields (struct_name, field, byte_offset)."""
    own = nodes.where(F.col("node_type").isin("struct", "union"))
    met = own.join(fields, own["symbol_name"] == fields["struct_name"])
    return met.select(F.col("id").alias("src"), F.concat_ws(".", "struct_name", "field").alias("dst"), "byte_offset", F.lit("FIELD_TO_OFFSET").alias("edge_type"))


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """src, via, dst over an edge of the first type and then one of the second."""
    a = edges.where(F.col("edge_type") == first).select("src", F.col("dst").alias("via"))
    b = edges.where(F.col("edge_type") == second).select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").select("src", "via", "dst")


def unmatched(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of a symbol kind that no binary symbol names."""
    kinds = ["function", "struct", "union", "enum", "macro"]
    return nodes.where(F.col("node_type").isin(kinds)).join(symbols.select(F.col("name").alias("symbol_name")), "symbol_name", "left_anti").select(nodes.columns)


def node_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, key, n: nodes, different symbols and edges in all, and by type; nodes by layer if they have one."""

    def counted(rows: DataFrame, metric: str, key: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")

    total = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("metric"), F.lit("").alias("key"), "n")
    total = total.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("metric"), F.lit("").alias("key"), "n"))
    total = total.unionByName(nodes.agg(F.countDistinct("symbol_name").alias("n")).select(F.lit("symbols").alias("metric"), F.lit("").alias("key"), "n"))
    if "layer" in nodes.columns:
        total = total.unionByName(counted(nodes, "layer", "layer").withColumn("key", F.col("key").cast("string")))
    return total.unionByName(counted(nodes, "node_type", "node_type")).unionByName(counted(edges, "edge_type", "edge_type"))
