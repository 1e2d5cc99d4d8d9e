"""Look-ups of nodes, symbols, fields and addresses, and counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.address import offset_ref, to_hex
from lodestone.operators import asof

#: Symbols whose address tells whether addresses are shown at all.
PROBED = ("_text", "startup_64")


# --- nodes ------------------------------------------------------------------------


def by_ids(nodes: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the given keys; keys without a row are left out."""
    return nodes.join(ids.select(key).distinct(), key, "left_semi")


def by_symbol(nodes: DataFrame, names: DataFrame, name: str = "symbol_name") -> DataFrame:
    return nodes.join(names.select(name).distinct(), name, "left_semi")


def metadata(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """A node's metadata: missing values as empty text, its code left out."""
    return nodes.select("id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def functions(nodes: DataFrame, least: int = 30) -> DataFrame:
    """Functions with a name and ``least`` characters of code."""
    return nodes.where((F.col("node_type") == "function") & (F.length("code") >= least) & (F.col("symbol_name") != ""))


def shortened(nodes: DataFrame, docstring: int = 300, code: int = 1000) -> DataFrame:
    return nodes.withColumns({"docstring": F.substring("docstring", 1, docstring), "code": F.substring("code", 1, code)})


def members(nodes: DataFrame, by: str, key: str = "id") -> DataFrame:
    """Group -> ids, one row a pair with its group's size: a group of very many ids is many rows."""
    n = nodes.groupBy(by).agg(F.count("*").alias("n"))
    return nodes.select(by, key).join(n, by)


# --- symbols ------------------------------------------------------------------------


def function_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.upper("sym_type").isin("T", "W"))


def module_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("module") != "")


def readable(symbols: DataFrame, probed: tuple[str, ...] = PROBED) -> DataFrame:
    """One row: whether a probed symbol has an address."""
    return symbols.agg(F.coalesce(F.bool_or(F.col("name").isin(*probed) & (F.col("address") > 0)), F.lit(False)).alias("readable"))


def address_of(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """name, address: of the first entry (by line_no) with an address above 0; null if there is none."""
    first = symbols.where("address > 0").groupBy("name").agg(F.min_by("address", "line_no").alias("address"))
    return names.select("name").distinct().join(first, "name", "left")


def entries_of(symbols: DataFrame, names: DataFrame) -> DataFrame:
    return symbols.join(names.select("name").distinct(), "name", "left_semi")


def symbol_stats(symbols: DataFrame, probed: tuple[str, ...] = PROBED) -> DataFrame:
    """One row: symbols, unique names, modules, whether addresses are readable."""
    known = F.col("name").isin(*probed) & (F.col("address") > 0)
    return symbols.agg(F.count("*").alias("total_symbols"), F.countDistinct("name").alias("unique_names"), F.countDistinct(F.when(F.col("module") != "", F.col("module"))).alias("modules"), F.coalesce(F.bool_or(known), F.lit(False)).alias("readable"))


def symbol_types(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("sym_type").agg(F.count("*").alias("n"))


def modules(symbols: DataFrame) -> DataFrame:
    return module_symbols(symbols).select("module").distinct()


def binary_stats(binary: DataFrame, fields: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: functions, structures, fields and lines of a binary."""
    one = binary.agg(F.count("*").alias("functions"), F.countDistinct("name").alias("names"))
    return one.crossJoin(fields.agg(F.countDistinct("struct_name").alias("structs"), F.count("*").alias("fields"))).crossJoin(lines.agg(F.count("*").alias("lines")))


def field_offsets(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (struct_name, field) with byte_offset; null for an unknown field."""
    return wanted.join(fields.select("struct_name", "field", "byte_offset"), ["struct_name", "field"], "left")


def fields_at(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (struct_name, offset) with the field that covers the offset, the innermost if several do."""
    met = wanted.join(fields, "struct_name").where((F.col("byte_offset") <= F.col("offset")) & (F.col("offset") < F.col("byte_offset") + F.col("byte_size")))
    best = met.groupBy("struct_name", "offset").agg(F.min_by("field", F.struct("byte_size", "field")).alias("field"))
    return wanted.join(best, ["struct_name", "offset"], "left")


# --- addresses ------------------------------------------------------------------------


def inline_chain(addresses: DataFrame, binary: DataFrame, bucket: Column | None = None) -> DataFrame:
    """address, chain: at most the function that holds the address."""
    found = asof.containing_function(addresses, binary, bucket)
    return found.select("address", F.when(F.col("match").isNull(), F.array().cast("array<string>")).otherwise(F.array("match.name")).alias("chain"))


def addr2line(addresses: DataFrame, live: DataFrame, binary: DataFrame, lines: DataFrame, nodes: DataFrame, slide: int = 0, bucket: Column | None = None) -> DataFrame:
    """address, hex, live_ref, function, file, line, node: every step may fail and leaves nulls.

    ``live``: address, name, line_no; ``binary``: addr_start, addr_end, name, source_file, source_line;
    ``lines``: address, file_path, line; ``nodes``: id, symbol_name.  ``slide``: live less static addresses.
    """
    kind = addresses.schema["address"].dataType
    still = (F.col("address") - F.lit(slide)).cast(kind).alias("address")
    named = live.where("address > 0").groupBy("address").agg(F.min_by("name", F.struct(F.col("line_no").isNull(), "line_no", "name")).alias("name"))
    near = named.select(still, F.struct("name", F.col("address").alias("start")).alias("near"))
    # Nodes are met by functions, of which there are fewer than addresses.
    first = nodes.groupBy(F.col("symbol_name").alias("name")).agg(F.min("id").alias("node"))
    inside = binary.join(first, "name", "left").groupBy(F.col("addr_start").cast(kind).alias("address")).agg(F.max(F.struct("addr_end", "name", "source_file", "source_line", "node")).alias("inside"))
    at = lines.groupBy(F.col("address").cast(kind).alias("address")).agg(F.max(F.struct("file_path", "line")).alias("at"))
    met = asof.asof_all(addresses.select(still), {"near": near, "inside": inside, "at": at}, "address", bucket)
    found = met.withColumn("inside", F.when(F.col("address") < F.col("inside.addr_end"), F.col("inside"))).withColumn("given", (F.col("address") + F.lit(slide)).cast(kind))
    return found.select(
        F.col("given").alias("address"), to_hex(F.col("given")).alias("hex"), F.when(F.col("near").isNotNull(), offset_ref(F.col("near.name"), F.col("given"), F.col("near.start"))).alias("live_ref"), F.col("inside.name").alias("function"),
        F.coalesce("at.file_path", "inside.source_file").alias("file"), F.coalesce("at.line", "inside.source_line").alias("line"), F.col("inside.node").alias("node"),
    )


def line_ref(path: Column, line: Column) -> Column:
    """file:line, or the file alone."""
    return F.when(line > 0, F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)
