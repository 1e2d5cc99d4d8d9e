"""Training rows for retrieval models: queries, negatives, splits, curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import first_sentence, path_subsystem
from lodestone.operators.ranking import numbered
from lodestone.session import written


def time_split(date: Column, val: str, test: str) -> Column:
    """train before ``val``, val before ``test``, test from then on."""
    return F.when(date < F.lit(val).cast("timestamp"), "train").when(date < F.lit(test).cast("timestamp"), "val").otherwise("test")


def curriculum_ratio(hard_ratio: Column, epoch: Column, total_epochs: Column, difficulty: Column) -> Column:
    """Share of hard negatives: easy rows first, all of ``hard_ratio`` in the last epoch."""
    progress = F.when(total_epochs <= 1, F.lit(1.0)).otherwise(epoch / F.greatest(total_epochs - 1, F.lit(1)))
    ratio = hard_ratio * (progress + (F.lit(1.0) - progress) * (F.lit(1.0) - difficulty))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))


def mixed(seed: int, *keys: Column) -> Column:
    """A sampling order that every engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))


def sampled(rows: DataFrame, seed: int, n: int, key: str, by: list[str]) -> DataFrame:
    """n rows of each group in the order of ``mixed``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(mixed(seed, F.col(key)), key))
    return rows.withColumn("pick", rank).where(F.col("pick") <= n)


def easy_negatives(queries: DataFrame, pool: DataFrame, seed: int, n: int, positives: DataFrame | None = None) -> DataFrame:
    """query, id, pick: n different ids of the pool for every query, none of its group and none of its positives; all there are if fewer.

    ``queries``: query, grp; ``pool``: id, grp; ``positives``: query, id.  The pool is numbered by
    group and id.  What is left to a query is cut into n equal stretches, and a hash draws
    one number of each; the number then skips what lies before it of the query's own group
    and positives.  So every row that is allowed can be drawn, and none twice.
    """
    rows = written(numbered(pool.select("id", "grp"), ["grp", "id"], "at"), "pool")
    groups = rows.groupBy("grp").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    asked = queries.select("query", "grp").join(groups, "grp", "left").select("query", "grp", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("size", F.lit(0)).alias("size"))
    block = F.struct(F.col("start").alias("start"), F.col("size").alias("size"))
    if positives is None:
        blocked = asked.select("query", "grp", F.array(block).alias("blocks"))
    else:
        own = positives.select("query", "id").distinct().join(rows, "id").select("query", F.col("grp").alias("of"), "at")
        apart = own.join(asked.select("query", "grp"), "query").where("of <> grp").groupBy("query").agg(F.collect_list(F.struct(F.col("at").alias("start"), F.lit(1).cast("long").alias("size"))).alias("more"))
        blocked = asked.join(apart, "query", "left").select("query", "grp", F.array_sort(F.concat(F.array(block), F.coalesce("more", F.array().cast("array<struct<start:bigint,size:bigint>>")))).alias("blocks"))
    total = rows.agg(F.count("*")).scalar()
    left = total - F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b["size"])
    sized = blocked.withColumn("left", left).withColumn("picks", F.least(F.col("left"), F.lit(n))).where("picks > 0")
    drawn = sized.select("query", "blocks", "left", "picks", F.explode(F.sequence(F.lit(1), F.col("picks").cast("int"))).alias("pick"))
    low, high = (F.floor(F.col("left") * (F.col("pick") - i) / F.col("picks")) for i in (1, 0))
    hashed = F.conv(F.substring(mixed(seed, F.col("query"), F.col("pick")), 1, 12), 16, 10).cast("long")
    placed = drawn.withColumn("at", low + hashed % (high - low))
    skipped = F.aggregate("blocks", F.col("at"), lambda at, b: F.when(at >= b["start"], at + b["size"]).otherwise(at))
    return placed.select("query", "pick", skipped.alias("at")).join(rows.select("at", "id"), "at").select("query", "id", "pick")


def symbol_queries(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat(F.lit("how does "), F.col("symbol_name"), F.lit(" work")).alias("query"), F.array("id").alias("positives"), F.lit(0.5).alias("difficulty"), F.lit("symbol").alias("source"))


def sentence_queries(nodes: DataFrame, sentence: Column) -> DataFrame:
    return nodes.withColumn("query", sentence).where("query IS NOT NULL").select("query", F.array("id").alias("positives"), F.lit(0.3).alias("difficulty"), F.lit("docstring").alias("source"))


def caller_queries(edges: DataFrame) -> DataFrame:
    """dst, positive, n_callers: one row for every caller of every callee, so that a callee of very many callers is many rows."""
    pairs = edges.select("src", "dst").distinct()
    n = pairs.groupBy("dst").agg(F.count("*").alias("n_callers"))
    return pairs.join(n, "dst").select("dst", F.col("src").alias("positive"), "n_callers")


def callers_index(nodes: DataFrame) -> DataFrame:
    """callee, callers (ids), subsystems: who names a callee in its calls, and where those live; nodes (id, file_path, calls)."""
    pairs = nodes.select(F.explode(F.array_distinct("calls")).alias("callee"), "id", path_subsystem(F.col("file_path")).alias("subsystem")).where("callee <> ''")
    return pairs.groupBy("callee").agg(F.sort_array(F.collect_set("id")).alias("callers"), F.sort_array(F.collect_set("subsystem")).alias("subsystems"))


def callee_queries(nodes: DataFrame) -> DataFrame:
    """query, positives (all callers), difficulty, source for every callee."""
    index = callers_index(nodes)
    return index.select(F.concat(F.lit("find functions that call "), "callee").alias("query"), F.col("callers").alias("positives"), F.lit(0.7).alias("difficulty"), F.lit("caller_callee").alias("source"))


#: Characters of the shortest function that a question is made of.
LEAST_CODE = 30


def strategies(nodes: DataFrame, least: int = LEAST_CODE) -> list[DataFrame]:
    """The rows of all four strategies: nodes (id, symbol_name, file_path, code, docstring, calls) whose code has ``least`` characters."""
    own = nodes.where(F.length("code") >= least)
    groups = own.select("id", path_subsystem(F.col("file_path")).alias("subsystem"), F.length("code").alias("size"))
    named = own.where(F.coalesce("symbol_name", F.lit("")) != "")
    return [symbol_queries(named), sentence_queries(own, first_sentence(F.col("docstring"), F.col("code"))), callee_queries(own), subsystem_queries(groups)]


#: What well-known subsystems are about.
TOPICS = {
    "mm": "memory management",
    "kernel": "core kernel",
    "fs": "filesystem",
    "net": "networking",
    "drivers": "device drivers",
    "arch": "architecture",
    "block": "block I/O",
    "crypto": "cryptography",
    "ipc": "inter-process communication",
    "security": "security",
    "sound": "audio",
    "lib": "library utilities",
}


def subsystem_queries(nodes: DataFrame) -> DataFrame:
    """query, positives (the five longest), difficulty, source of every subsystem with three nodes at least; nodes (id, subsystem, size)."""
    best = largest_of_each(nodes, "subsystem", "size", "id")
    topic = F.coalesce(F.create_map(*(F.lit(x) for pair in TOPICS.items() for x in pair))[F.col("subsystem")], F.regexp_replace("subsystem", "_", " "))
    listed = best.groupBy("subsystem").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("positives"))
    return listed.select(F.concat(F.lit("explain "), topic, F.lit(" in "), "subsystem").alias("query"), "positives", F.lit(0.6).alias("difficulty"), F.lit("subsystem").alias("source"))


def generated(parts: list[DataFrame], seed: int = 42, most: int = 2000) -> DataFrame:
    """query, positives, difficulty, source, place: at most ``most`` rows of each strategy, in a seeded order of all."""
    kept = [p.orderBy(mixed(seed, F.col("query"), F.col("positives").cast("string")), "query").limit(most) for p in parts]
    rows = kept[0]
    for p in kept[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("place", mixed(seed, F.col("source"), F.col("query"), F.col("positives").cast("string")))


def batches(rows: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """Rows with batch and slot: a seeded order cut into batches of about ``size`` by a hash, so no task sees all rows.  ``key`` names a row."""
    n = F.lit(max(1, -(-rows.count() // size)))
    return rows.withColumn("batch", (F.conv(F.substring(mixed(seed, F.col(key)), 1, 12), 16, 10).cast("long") % n).cast("int")).withColumn("slot", F.row_number().over(Window.partitionBy("batch").orderBy(mixed(seed, F.col(key), F.lit("slot")), key)))


def held_out_share(rows: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """Rows with ``split``: val for a seeded ``percent`` of the keys, else train."""
    digits = F.conv(F.substring(mixed(seed, F.col(key)), 1, 12), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(digits < percent, "val").otherwise("train"))


def mined(log: DataFrame, starts: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """Commits with the functions that their hunks touch, fit for training.

    ``log``: sha, date, subject, files; ``starts``: sha, file, line (a hunk's first new line);
    ``ranges``: sha, file, start, end, ordinal, name (functions of that revision).
    """
    from lodestone.operators.asof import range_first

    own = ranges.select("sha", "file", "start", "end", "ordinal", "name")
    met = range_first(starts.select("sha", "file", "line").distinct(), own, "line", ["sha", "file"], "ordinal", width)
    ids = met.groupBy("sha").agg(F.array_sort(F.collect_set(F.concat_ws("::", "file", "match.name"))).alias("positives"))
    return useful_commits(log.join(ids, "sha"))


def enriched(scores: DataFrame, positives: DataFrame, groups: DataFrame, pool: DataFrame, k: int = 16, least: int = 8, seed: int = 42) -> DataFrame:
    """query, hard (ids), easy (ids), gap, difficulty.

    ``scores``: query, doc, score; ``positives``: query, doc; ``groups``: query, grp; ``pool``: id, grp.
    Hard negatives are of the query's own group, or of any where that gives fewer than ``least``.
    """
    from lodestone.operators import bm25

    # Read several times below.
    scores, positives = written(scores, "scores"), written(positives, "positives")
    same = scores.join(pool.select(F.col("id").alias("doc"), "grp"), "doc").join(groups, ["query", "grp"], "left_semi").select("query", "doc")
    close = bm25.hard_negatives(scores, positives, k, same)
    short = positives.select("query").distinct().join(close.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) < least).select("query")
    wide = bm25.hard_negatives(scores.join(short, "query", "left_semi"), positives, k)
    hard = written(close.join(short, "query", "left_anti").select("query", "rank", "doc", "score").unionByName(wide.select("query", "rank", "doc", "score")), "hard")
    easy = easy_negatives(groups, pool, seed, 8, positives.select("query", F.col("doc").alias("id")))
    marked = bm25.difficulty_rank(bm25.difficulty_gap(scores, positives, hard))

    def listed(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
        return rows.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(name))

    return marked.join(listed(hard, "rank", "doc", "hard"), "query", "left").join(listed(easy, "pick", "id", "easy"), "query", "left")


def largest_of_each(rows: DataFrame, by: str, size: str, key: str, k: int = 5, least: int = 3) -> DataFrame:
    """The k largest rows of every group that has ``least`` at least."""
    n = F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(size), key))
    return rows.withColumn("n", n).withColumn("rank", rank).where((F.col("n") >= least) & (F.col("rank") <= k)).drop("n")


#: Fixed value: subjects that teach nothing.
NOISE = r"(?i)^(Merge |Revert |Linux \d|MAINTAINERS|Signed-off|fixup!|CHROMIUM:|ANDROID:|[Bb]ump version)"


def useful_commits(commits: DataFrame, least: int = 1, most: int = 8) -> DataFrame:
    """Commits (subject, files, positives) fit for training: no noise, a subject of 20 characters, positives, and more than headers."""
    named = ~F.col("subject").rlike(NOISE) & (F.length("subject") >= 20)
    return commits.where(named & F.size("positives").between(least, most) & ~F.forall("files", lambda f: f.endswith(".h")))


def training_items(triplets: DataFrame, negatives: int, epoch: int, total: int, seed: int, hard_ratio: float = 1.0) -> DataFrame:
    """One positive and ``negatives`` negatives of each triplet, hard ones by the curriculum; short lists are not filled up."""
    ratio = curriculum_ratio(F.lit(hard_ratio), F.lit(epoch), F.lit(total), F.col("difficulty"))
    n_hard = F.floor(F.lit(negatives) * ratio).cast("int")

    def first(column: str, n: Column) -> Column:
        order = F.array_sort(F.transform(column, lambda x: F.struct(mixed(seed, F.lit(epoch), x).alias("o"), x.alias("x"))))
        return F.transform(F.slice(order, F.lit(1), n), lambda s: s["x"])

    return triplets.select("query", F.get(first("positives", F.lit(1)), 0).alias("positive"), F.concat(first("hard_negatives", n_hard), first("easy_negatives", F.lit(negatives) - n_hard)).alias("negatives"))
