"""Paths of a running system to the code behind them: rules first, then vector search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import query_text
from lodestone.operators.vector_search import HyperplaneIndex
from lodestone.session import written

#: Patterns of well-known paths, with the files, functions and structures behind them, and a description (our own words).
#: The first that matches a whole path wins.
KNOWN_PATHS = [
    (r"/sys/class/net/\w+/operstate", ["net/core/net-sysfs.c"], ["operstate_show"], ["net_device"], "A network interface's operational state, an IF_OPER_ value of its net_device; drivers change it as the carrier comes and goes."),
    (r"/sys/class/net/\w+/speed", ["net/core/net-sysfs.c"], ["speed_show"], ["net_device", "ethtool_link_ksettings"], "The link's speed in megabits a second, asked of the driver through its link settings operation."),
    (r"/sys/class/net/\w+/mtu", ["net/core/net-sysfs.c"], ["mtu_show", "mtu_store"], ["net_device"], "The largest packet of an interface in bytes; a write is checked against the driver's limits."),
    (r"/sys/class/net/\w+/tx_queue_len", ["net/core/net-sysfs.c"], ["tx_queue_len_show", "tx_queue_len_store"], ["net_device"], "How many packets may wait to be sent before traffic control acts."),
    (r"/sys/devices/system/cpu/cpu\d+/cpufreq/scaling_cur_freq", ["drivers/cpufreq/cpufreq.c"], ["show_scaling_cur_freq"], ["cpufreq_policy", "cpufreq_driver"], "The processor's frequency in kilohertz, as the frequency driver last set it in the policy."),
    (r"/sys/devices/system/cpu/cpu\d+/topology/core_id", ["drivers/base/topology.c"], ["core_id_show"], ["cpu_topology"], "The physical core of a logical processor, found at boot from the firmware's tables."),
    (r"/proc/schedstat", ["kernel/sched/stats.c"], ["show_schedstat"], ["rq", "sched_info"], "Counts and times of the scheduler, for each processor since boot."),
    (r"/proc/meminfo", ["fs/proc/meminfo.c"], ["meminfo_proc_show"], ["sysinfo", "vm_stat"], "The system's memory by kind; most numbers are summed over zones and processors as they are read."),
    (r"/proc/\d+/maps", ["fs/proc/task_mmu.c"], ["show_map", "proc_pid_maps_open"], ["vm_area_struct", "mm_struct"], "A process's areas of virtual memory, a line each with its permissions and what backs it."),
    (r"/proc/\d+/status", ["fs/proc/array.c"], ["proc_pid_status"], ["task_struct", "mm_struct", "cred"], "A process's names, memory, threads and credentials in words, from its task structure."),
    (r"/proc/\d+/smaps", ["fs/proc/task_mmu.c"], ["show_smap"], ["vm_area_struct", "mem_size_stats"], "A process's areas of memory with resident and proportional sizes; page tables are walked, so it costs more than maps."),
    (r"/proc/\d+/stat", ["fs/proc/array.c"], ["do_task_stat"], ["task_struct", "signal_struct"], "A process's times, state and sizes on one line, as tools that list processes read it."),
    (r"/proc/\d+/cmdline", ["fs/proc/base.c"], ["proc_pid_cmdline_read"], ["mm_struct", "task_struct"], "A process's arguments, parted by zero bytes, read from its own address space."),
    (r"/sys/block/\w+/queue/scheduler", ["block/elevator.c", "block/blk-sysfs.c"], ["elv_iosched_show", "elv_iosched_store"], ["elevator_type", "request_queue"], "A disk's request scheduler; a write changes over to the one it names."),
    (r"/sys/block/\w+/stat", ["block/blk-sysfs.c"], ["queue_stat_show"], ["disk_stats", "gendisk"], "Reads and writes that a disk has done, their sectors and times, summed over processors."),
    (r"/sys/class/power_supply/\w+/capacity", ["drivers/power/supply/power_supply_sysfs.c"], ["power_supply_show_property"], ["power_supply", "power_supply_desc"], "A battery's charge in percent, asked of the driver of its gauge."),
]


def rules(spark: SparkSession) -> DataFrame:
    """ordinal, pattern, files, functions, structs, description: the rule table, a bounded parameter."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(KNOWN_PATHS)], "ordinal int, pattern string, files array<string>, functions array<string>, structs array<string>, description string")


def _parts(path: Column) -> Column:
    return F.split(F.trim(path, F.lit("/")), "/")


def scan_query(path: Column) -> Column:
    """The question that a path without a rule becomes."""
    parts = _parts(path)
    area = F.when(F.size(parts) > 2, F.get(parts, 1)).otherwise("")
    return F.concat(F.lit("sysfs attribute "), F.regexp_replace(F.element_at(parts, -1), "_", " "), F.lit(" show read write store handler function "), area, F.lit(" kernel"))


def handler_query(path: Column) -> Column:
    """The question for a path's handlers, asked of functions only."""
    parts = _parts(path)
    area = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")
    return F.concat(F.lit("sysfs attribute handler for "), F.regexp_replace(F.element_at(parts, -1), "_", " "), F.lit(" in "), area, F.lit(" subsystem, show store read write function"))


def matched(paths: DataFrame, table: DataFrame) -> DataFrame:
    """path with the first rule (ordinal, pattern) that matches all of it; paths without one are left out.

    Every path meets every rule, inside a task: the rules are few and go to every task as one array.
    """
    listed = table.agg(F.array_sort(F.collect_list(F.struct("ordinal", "pattern"))).alias("rules"))
    met = paths.select(F.trim("path").alias("path")).distinct().withColumn("rules", listed.scalar())
    first = F.get(F.filter("rules", lambda r: F.regexp_like(F.col("path"), F.concat(F.lit("^(?:"), r["pattern"], F.lit(")$")))), 0)["ordinal"]
    return met.select("path", first.alias("ordinal")).where("ordinal IS NOT NULL")


#: What is said of a path that nothing was found for.
UNKNOWN = "No rule and no indexed code matches this path."


def scanned(paths: DataFrame, table: DataFrame, hits: DataFrame | None = None, live: DataFrame | None = None, ruled: DataFrame | None = None) -> DataFrame:
    """path, files, functions, structs, description, live_value, confidence: high by rule, medium by the vector hits of what has none, else low.

    ``hits``: path, rank, score, file_path, symbol_name, node_type, docstring (up to five a path; the best's docstring
    describes the path); ``live``: path, value, as it was read on the running system; ``ruled``: what ``matched``
    gives for the paths, where that is known already.
    """
    asked = paths.select(F.trim("path").alias("path")).distinct()
    none = F.array().cast("array<string>")
    found = asked.join((matched(paths, table) if ruled is None else ruled).join(table, "ordinal").select("path", "files", "functions", "structs", "description"), "path", "left")
    by_rule = F.col("files").isNotNull()
    if hits is None:
        found = found.withColumn("confidence", F.when(by_rule, "high").otherwise("low"))
    else:
        ordered = hits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "symbol_name", "node_type", "docstring"))).alias("h"))

        def names(kinds: list[str]) -> Column:
            return F.transform(F.filter("h", lambda s: s["node_type"].isin(kinds)), lambda s: s["symbol_name"])

        best = F.get("h", 0)
        said = F.when(F.trim(best["docstring"]) != "", best["docstring"]).otherwise(F.concat(F.lit("Nearest code: "), best["symbol_name"], F.lit(" in "), best["file_path"]))
        near = ordered.select("path", F.array_distinct(F.transform("h", lambda s: s["file_path"])).alias("f"), names(["function"]).alias("g"), names(["struct", "union"]).alias("s"), said.alias("said"))
        met = found.join(near, "path", "left")
        level = F.when(by_rule, "high").when(F.col("f").isNotNull(), "medium").otherwise("low")
        # A rule's lists stand as they are; only a path without a rule takes what the search has found.
        found = met.select("path", level.alias("confidence"), *(F.when(by_rule, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("files", "f"), ("functions", "g"), ("structs", "s"), ("description", "said"))))
    values = live.groupBy(F.trim("path").alias("path")).agg(F.max("value").alias("live_value")) if live is not None else None
    found = found.join(values, "path", "left") if values is not None else found.withColumn("live_value", F.lit(None).cast("string"))
    return found.select("path", *(F.coalesce(c, none).alias(c) for c in ("files", "functions", "structs")), F.coalesce("description", F.lit(UNKNOWN)).alias("description"), "live_value", "confidence")


def nearest(asked: DataFrame, index: HyperplaneIndex, embed: Callable[[Column], Column], k: int, share: float, nodes: DataFrame | None = None, where: str | None = None) -> DataFrame:
    """path, rank, id, score, and what ``nodes`` (id, ...) says of the hits: for each question (path, question) the k nearest rows of the index, of those that ``where`` holds for.

    Questions of one vector have the same hits, so each vector is searched once and its hits are
    dealt to its paths.  Ids are not below 0 and a vector's number is, so none is taken for the query itself.
    """
    number = F.xxhash64("q").bitwiseOR(F.lit(-(2**63))).alias("query")
    vectors = written(asked.select("path", embed(F.col("question")).alias("q")).select("path", number, "q"), "asked")
    found = index.search(written(vectors.select("query", "q").distinct(), "questions"), k, share, where=where)
    found = written(found if nodes is None else found.join(nodes, "id"), "hits")
    return vectors.select("query", "path").join(found, "query").drop("query")


def handler_hits(asked: DataFrame, index: HyperplaneIndex, embed: Callable[[Column], Column], k: int = 5, share: float = 0.7) -> DataFrame:
    """path, rank, id, score: for each path (path) the k functions of the index that its handlers' question is nearest to.

    ``index``: rows (id, v, node_type); only functions are searched.
    """
    trimmed = asked.select(F.trim("path").alias("path")).distinct()
    questions = trimmed.select("path", query_text(handler_query(F.col("path"))).alias("question"))
    return nearest(questions, index, embed, k, share, where="node_type = 'function'").select("path", "rank", "id", "score")
