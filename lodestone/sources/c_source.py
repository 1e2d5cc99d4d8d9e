"""C source files as node rows.

One pass over a file blanks comments, strings and preprocessor lines (same length,
so offsets stay), then top-level braces tell functions and bodied types apart.
Which identifiers are structs is known only over all files, so references are
resolved in a second step, against all struct names of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.functions.text import includes

NODE = "id string, node_type string, symbol_name string, file_path string, line_start int, line_end int, code string, docstring string, calls array<string>, names array<string>"
#: Parts of paths that are not indexed.
SKIPPED = [".mod.c", ".tmp.", "compat_ioctl", "/test/", "/tests/", "/.git/", "/tools/testing/"]
#: Structures that references are looked for from the start.
CORE_STRUCTS = [
    "task_struct", "mm_struct", "vm_area_struct", "file", "inode",
    "socket", "sk_buff", "net_device", "super_block", "dentry",
    "page", "address_space", "bio", "request", "wait_queue_head",
    "mutex", "spinlock_t", "rcu_head", "kobject", "device",
    "pci_dev", "platform_device", "irq_desc", "timer_list",
    "work_struct", "delayed_work", "completion", "semaphore",
    "rq", "cfs_rq", "rt_rq", "sched_entity", "sched_class",
    "pglist_data", "zone", "page_pool", "kmem_cache",
    "sock", "tcp_sock", "inet_sock", "net", "net_proto_family",
    "gendisk", "block_device", "elevator_queue",
    "rwlock_t", "rwsem",
]
#: Bytes of the largest file that is read.
MOST_BYTES = 2 << 20
#: Characters of texts and rows that leave a task at once, and what a row counts for.
RUN, ROW = 1 << 20, 200
#: What two versions of a node are compared by.
BODY = "id string, node_type string, code string, docstring string"
#: Words that are followed by a parenthesis without being calls.
_NO_CALLS = {"if", "for", "while", "switch", "return", "sizeof", "typeof", "defined", "do", "else", "case"}
_NAME = re.compile(r"[A-Za-z_]\w*")
_CALL = re.compile(r"(?<![\w.>])([A-Za-z_]\w*)\s*\(")
_TYPE = re.compile(r"\b(struct|union|enum)\s+([A-Za-z_]\w*)\s*(?:__\w+(?:\([^()]*\))?\s*)*$")
_FUNCTION = re.compile(r"([A-Za-z_]\w*)\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?:__\w+(?:\([^()]*\))?\s*)*$")
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\([^)\n]*\))?[ \t]*((?:[^\n]*\\\n)*[^\n]*)", re.M)


def blanked(code: str) -> str:
    """The text with comments, literals and preprocessor lines as spaces."""
    pattern = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", re.S | re.M)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def comment_above(lines: list[str], line: int) -> str:
    """The block comment that ends right above a line (1-based)."""
    at, found = line - 2, []
    while at >= 0:
        own = lines[at].strip()
        if own.startswith(("/*", "*")) or own.endswith("*/"):
            found.append(own)
            if own.startswith("/*"):
                break
        elif own or found:
            break
        at -= 1
    return "\n".join(reversed(found)) if found and found[-1].startswith("/*") else ""


def extract(path: str, code: str) -> list[dict]:
    """Rows of structs, unions, enums, functions and macros, and of the file if it includes any."""
    clean, lines = blanked(code), code.split("\n")
    rows: dict[str, dict] = {}

    def put(kind: str, name: str, start: int, end: int) -> None:
        first, last = code.count("\n", 0, start) + 1, code.count("\n", 0, max(start, end - 1)) + 1
        body = clean[start:end]
        calls = sorted({c for c in _CALL.findall(body[body.find("{") :]) if c not in _NO_CALLS and not c.startswith("__")}) if kind == "function" else []
        names = sorted(set(_NAME.findall(body))) if kind in ("function", "struct", "union") else []
        rows[f"{path}::{name}"] = {"id": f"{path}::{name}", "node_type": kind, "symbol_name": name, "file_path": path, "line_start": first, "line_end": last, "code": code[start:end], "docstring": comment_above(lines, first), "calls": calls, "names": names}

    depth = begin = 0
    spans: list[tuple[str, str, int, int]] = []
    head, opened = "", 0
    for m in re.finditer(r"[{};]", clean):
        if m[0] == "{":
            if depth == 0:
                head, opened = clean[begin : m.start()], begin
            else:
                inner = _TYPE.search(clean[max(0, m.start() - 200) : m.start()])
                if inner and inner[1] in ("struct", "union"):
                    end = _closing(clean, m.start())
                    spans.append((inner[1], inner[2], max(0, m.start() - 200) + inner.start(), end))
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                start = opened + len(head) - len(head.lstrip())
                kind, function = _TYPE.search(head), _FUNCTION.search(head.rstrip())
                if kind:
                    spans.append((kind[1], kind[2], opened + kind.start(), m.end()))
                elif function and function[1] not in _NO_CALLS and "=" not in head:
                    spans.append(("function", function[1], start, m.end()))
                    begin = m.end()
                if not kind:
                    begin = m.end()
                else:
                    begin = m.end()
        elif depth == 0:
            begin = m.end()
    for wanted in ("struct", "union", "function", "enum"):
        for kind, name, start, end in spans:
            if kind == wanted:
                put(kind, name, start, end)
    for m in _MACRO.finditer(code):
        value = m[3].strip()
        if value and not (len(value) < 4 and value.isdigit()):
            put("macro", m[1], m.start(), m.end())
    return list(rows.values())


def _closing(clean: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(clean, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(clean)


def read_sources(spark: SparkSession, root: str, glob: str = "*.[ch]") -> DataFrame:
    """path (below root), content of source files that aren't skipped or too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\."), "")
    rows = files.where(F.col("length") <= MOST_BYTES).select(F.ltrim(path, F.lit("/")).alias("path"), F.col("content").cast("string").alias("content"))
    return rows.where(~skipped(F.col("path")))


def skipped(path: Column) -> Column:
    found = F.lit(False)
    for part in SKIPPED:
        found = found | path.contains(part)
    return found


def runs(batch: pa.RecordBatch, made: Callable[..., list[dict]]) -> Iterator[list[dict]]:
    """What ``made`` gives for each row of a batch, in runs of about RUN characters, of the texts and ROW a row."""
    held, size = [], 0
    for at in range(batch.num_rows):
        *keys, text = (c[at].as_py() for c in batch.columns)
        found = made(*keys, text or "")
        held += found
        size += len(text or "") + ROW * len(found)
        if size >= RUN:
            yield held
            held, size = [], 0
    if held:
        yield held


def in_runs(rows: DataFrame, schema: str, made: Callable[..., list[dict]]) -> DataFrame:
    """The rows that ``made`` gives for the values of each row, whose last is a text (null: empty).

    A task takes one text at a time out of a batch, and what it made leaves by runs: neither grows with a batch's rows.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in runs(batch, made):
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, kind)


def _file_nodes(sources: DataFrame) -> DataFrame:
    """A node for every file that includes any."""
    empty = F.array().cast("array<string>")
    heads = sources.withColumn("includes", includes(F.col("content"))).where(F.size("includes") > 0)
    return heads.select(
        F.concat("path", F.lit("::__file__")).alias("id"), F.lit("file").alias("node_type"), F.element_at(F.split("path", "/"), -1).alias("symbol_name"), F.col("path").alias("file_path"), F.lit(1).alias("line_start"),
        F.size(F.split("content", "\n")).alias("line_end"), F.substring("content", 1, 512).alias("code"), F.lit("").alias("docstring"), empty.alias("calls"), empty.alias("uses_structs"), "includes",
    )


def bodies(sources: DataFrame) -> DataFrame:
    """id, node_type, code, docstring of the nodes of sources (path, content): one pass, no references."""
    found = in_runs(sources.select("path", "content"), BODY, extract)
    return found.unionByName(_file_nodes(sources).select(*found.columns))


def nodes(sources: DataFrame, known: list[str] | None = CORE_STRUCTS) -> DataFrame:
    """Node rows of sources (path, content): uses_structs holds names of structs of the corpus or of ``known``."""
    found = in_runs(sources.select("path", "content"), NODE, extract)
    structs = found.where("node_type IN ('struct', 'union')").select("symbol_name")
    if known:
        structs = structs.union(sources.sparkSession.createDataFrame([(k,) for k in known], "symbol_name string"))
    # Names meet the struct names by an equi-join; only hits are gathered again.
    named = found.select("id", "node_type", "symbol_name", F.explode("names").alias("name")).where("name <> symbol_name")
    uses = named.join(structs.distinct().withColumnRenamed("symbol_name", "name"), "name").groupBy("id", "node_type").agg(F.array_sort(F.collect_set("name")).alias("uses_structs"))
    empty = F.array().cast("array<string>")
    rows = found.drop("names").join(uses, ["id", "node_type"], "left").withColumn("uses_structs", F.coalesce("uses_structs", empty)).withColumn("includes", empty)
    return rows.unionByName(_file_nodes(sources))
