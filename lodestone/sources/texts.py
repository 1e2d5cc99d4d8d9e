"""Line-oriented text sources: symbol tables, commit logs, diffs, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.address import parse_hex

SYMBOL = r"^([0-9a-f]+)\s+([A-Za-z])\s+(\S+)(?:\s+\[(\S+)\])?$"
TRIPLET = "query string, commit string, date date, positives array<string>, subsystem string, changed_files array<string>"
GOLD = "query string, relevant_ids array<string>, expected_symbols array<string>, expected_files array<string>"


def symbols(lines: DataFrame) -> DataFrame:
    """address DECIMAL(20,0), sym_type, name, module (empty if none) of lines (line_no, value); others are dropped."""
    part = lambda i: F.regexp_extract("value", SYMBOL, i)
    return lines.where(F.col("value").rlike(SYMBOL)).select("line_no", parse_hex(part(1)).alias("address"), part(2).alias("sym_type"), part(3).alias("name"), part(4).alias("module"))


def classified(rows: DataFrame) -> DataFrame:
    upper = F.upper("sym_type")
    return rows.withColumns({"is_function": upper.isin("T", "W"), "is_data": upper.isin("D", "B", "R"), "is_global": F.col("sym_type") == upper})


def hunk_starts(diffs: DataFrame) -> DataFrame:
    """Every hunk's first line on the new side, of diffs (sha, file, text)."""
    return diffs.select("sha", "file", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)"), F.lit(1))).alias("nth", "line")).withColumn("line", F.col("line").cast("int"))


def commits(log: DataFrame, since: str | None = None) -> DataFrame:
    """sha, date, subject, files of a log of blocks (value): 'sha|date|subject', then a file a line; only .c and .h."""
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, 0), r"\|", 3)
    files = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda f: f.rlike(r"\.[ch]$"))
    rows = log.select(F.get(head, 0).alias("sha"), F.to_date(F.substring(F.get(head, 1), 1, 10)).alias("date"), F.get(head, 2).alias("subject"), files.alias("files")).where(F.size("files") > 0)
    return rows if since is None else rows.where(F.col("date") >= F.lit(since).cast("date"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of a fixed schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cache_key(files: DataFrame) -> DataFrame:
    """path, key of binary files: time, size and crc32 of the first 64 KiB."""
    key = F.concat_ws("-", F.unix_seconds("modificationTime").cast("string"), F.col("length").cast("string"), F.crc32(F.substring("content", 1, 65536)).cast("string"))
    return files.select("path", key.alias("key"))


#: Characters of a live value that are kept.
LIVE_CHARS = 256


def live_values(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), value of the files there as they are now: white space around them goes, and so does what is beyond LIVE_CHARS."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    path = F.regexp_replace("path", "^.*?" + root.removeprefix("file://").rstrip("/").replace(".", r"\."), "")
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\s+|\s+$", "")
    return files.select(path.alias("path"), F.substring(text, 1, LIVE_CHARS).alias("value"))
