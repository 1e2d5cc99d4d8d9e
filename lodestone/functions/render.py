"""Results as text, for people and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.address import offset_ref, to_hex


def _listed(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("unknown")


def scan_text(row: Column) -> Column:
    """A path scan; ``row``: path, files, functions, structs, description, live_value, confidence."""
    # Fixed value: the form of the text.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("X-RAY: "), row["path"]),
        F.concat(F.lit("Confidence: "), row["confidence"]),
        F.lit(""),
        F.concat(F.lit("Source: "), _listed(row["files"])),
        F.concat(F.lit("Handlers: "), _listed(row["functions"])),
        F.concat(F.lit("Structs: "), _listed(row["structs"])),
        F.concat(F.lit("Live value: "), row["live_value"]),  # a null is left out
        F.lit(""),
        row["description"],
    )


def snapshot_text(row: Column) -> Column:
    """A live structure; ``row``: struct_name, instance_id, captured_at, context, fields (name, c_type, value)."""
    # Fixed value: the form of the text.
    fields = F.transform(row["fields"], lambda f: F.concat(F.lit("  ."), f["name"], F.lit(" ("), f["c_type"], F.lit(") = "), f["value"]))
    head = F.concat(F.lit("LIVE SNAPSHOT: "), row["struct_name"], F.lit(" @ "), row["instance_id"])
    context = F.when(row["context"] != "", F.concat(F.lit("Context: "), row["context"]))
    return F.concat_ws("\n", head, F.concat(F.lit("Captured: "), row["captured_at"]), context, F.lit(""), F.when(F.size(fields) > 0, F.array_join(fields, "\n")))


def process_text(row: Column) -> Column:
    """A process; ``row``: pid, comm, ppid, state, cpu, priority, flags, mm_ptr, files_ptr."""
    # Fixed value: the form of the text.
    parts = [F.lit("Process ["), row["pid"], F.lit("] "), row["comm"], F.lit("\n  ppid="), row["ppid"], F.lit(", state="), row["state"], F.lit(", cpu="), row["cpu"], F.lit(", prio="), row["priority"]]
    parts += [F.lit("\n  flags="), row["flags"], F.lit(", mm="), row["mm_ptr"], F.lit(", files="), row["files_ptr"]]
    return F.concat(*(p.cast("string") for p in parts))


def source_ref(address: Column, file: Column, line: Column, name: Column, start: Column, decl_file: Column, decl_line: Column) -> Column:
    """file:line [name+0x14] of an address; the function's declaration without a line, the address without either.

    ``file``, ``line``: from the line table, null if unknown; ``name``, ``start``, ``decl_file``, ``decl_line``: the function's.
    """
    place = F.concat(F.coalesce(file, decl_file), F.lit(":"), F.coalesce(line, decl_line).cast("string"))
    away = F.concat(F.lit(" ["), name, F.lit("+0x"), F.lower(F.hex((address - start).cast("long"))), F.lit("]"))
    return F.when(file.isNull() & name.isNull(), F.concat(to_hex(address), F.lit(" (unknown)"))).otherwise(F.concat(place, F.coalesce(away, F.lit(""))))


def address_text(row: Column) -> Column:
    """An address's look-up; ``row``: address, file, line, function, start, end, symbol, symbol_start, node; what is null is left out."""
    # Fixed value: the form of the text.
    away = F.lower(F.hex((row["address"] - row["start"]).cast("long")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("addr2line: "), to_hex(row["address"])),
        F.concat(F.lit("  Source:   "), row["file"], F.lit(":"), row["line"].cast("string")),
        F.concat(F.lit("  Function: "), row["function"], F.lit("()+0x"), away),
        F.concat(F.lit("  Range:    "), to_hex(row["start"]), F.lit("–"), to_hex(row["end"])),
        F.concat(F.lit("  Symbol:   "), offset_ref(row["symbol"], row["address"], row["symbol_start"]), F.lit(" (kallsyms)")),
        F.concat(F.lit("  Mirror:   "), row["node"]),
    )


def split_list(text: Column) -> Column:
    """The parts of a comma-separated list; empty ones are dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def similarity(distance: Column) -> Column:
    """The score of a cosine distance."""
    return F.lit(1.0) - distance
