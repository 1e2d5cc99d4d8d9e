"""Address, line and layout tables of a binary, from the rows of ``dwarf`` or of any reader that yields them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import path_suffixes
from lodestone.session import written

BINARY_SYMBOL = "name string, addr_start decimal(20,0), addr_end decimal(20,0), section string, source_file string, source_line int, symbol_type string, inline_depth int"
LINE_ENTRY = "address decimal(20,0), file_path string, line int, column int, is_stmt boolean, end_sequence boolean"
MEMBER = "parent string, name string, type string, byte_offset int, byte_size int"


def source_path(path: Column) -> Column:
    """The path below the source tree's root."""
    return F.regexp_replace(path, "^.*?/linux/", "")


def functions(rows: DataFrame) -> DataFrame:
    """Named functions with an address and a body."""
    return rows.where("name IS NOT NULL AND name <> '' AND addr_start > 0 AND addr_end > addr_start")


def lines(rows: DataFrame) -> DataFrame:
    return rows.where("NOT end_sequence AND address > 0 AND file_path IS NOT NULL")


def layouts(members: DataFrame) -> DataFrame:
    """struct_name, field, byte_offset, byte_size, c_type with anonymous members flattened, however deep; an outer field of a name wins.

    ``members``: an anonymous member has an empty name and the type that holds its members.
    """
    level = members.select(F.col("parent").alias("struct_name"), "name", "type", "byte_offset", "byte_size", F.lit(0).alias("depth"))
    found, depth = level, 0
    inner = members.select(F.col("parent").alias("type"), F.col("name").alias("n"), F.col("type").alias("t"), F.col("byte_offset").alias("o"), F.col("byte_size").alias("s"))
    while not (level := written(level.where("name = '' AND type <> struct_name"), "members")).isEmpty():
        depth += 1
        level = level.join(inner, "type").select("struct_name", F.col("n").alias("name"), F.col("t").alias("type"), (F.col("byte_offset") + F.col("o")).alias("byte_offset"), F.col("s").alias("byte_size"), F.lit(depth).alias("depth"))
        found = found.union(level)
    rank = F.row_number().over(Window.partitionBy("struct_name", "name").orderBy("depth", "byte_offset"))
    return found.where("name <> ''").withColumn("r", rank).where("r = 1").select("struct_name", F.col("name").alias("field"), "byte_offset", "byte_size", F.col("type").alias("c_type"))


def addresses_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (file, line) -> addresses of statements whose path ends in file, by an equi-join on path suffix and line."""
    ends = rows.where("is_stmt").select("address", "line", F.explode(path_suffixes(F.col("file_path"))).alias("file"))
    return ends.join(wanted, ["file", "line"]).select("file", "line", "address")


def file_names(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Line rows (cu, file_no, ...) with file_path from the units' tables of files (cu, file_no, dir, name)."""
    path = source_path(F.when(F.col("dir") != "", F.concat_ws("/", "dir", "name")).otherwise(F.col("name")))
    return lines.join(files.select("cu", "file_no", path.alias("file_path")), ["cu", "file_no"], "left")
