"""64-bit addresses as DECIMAL(20,0), and bytes of structures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def parse_hex(text: Column) -> Column:
    """An address from hexadecimal digits, with or without 0x."""
    return F.conv(F.regexp_replace(F.lower(text), "^0x", ""), 16, 10).cast(U64)


def to_hex(address: Column) -> Column:
    """0x and 16 digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.conv(address.cast("string"), 10, 16)), 16, "0"))


def offset_ref(name: Column, address: Column, start: Column) -> Column:
    """name+0x14, or the name alone at its start."""
    away = (address - start).cast("long")
    return F.when(away == 0, name).otherwise(F.concat(name, F.lit("+0x"), F.lower(F.hex(away))))


def decode_unsigned(raw: Column, offset: Column, size: Column, little_endian: bool = True) -> Column:
    """The unsigned number of 1, 2, 4 or 8 bytes at an offset; null for other sizes or beyond the end."""
    digits = F.regexp_extract_all(F.hex(F.substring(raw, offset + 1, size)), F.lit("(..)"), F.lit(1))
    number = F.conv(F.array_join(F.reverse(digits) if little_endian else digits, ""), 16, 10).cast(U64)
    return F.when(size.isin(1, 2, 4, 8) & (offset >= 0) & (offset + size <= F.octet_length(raw)), number)


#: Names of task states.
TASK_STATES = {
    0: "TASK_RUNNING",
    1: "TASK_INTERRUPTIBLE",
    2: "TASK_UNINTERRUPTIBLE",
    4: "TASK_STOPPED",
    8: "TASK_TRACED",
    16: "EXIT_DEAD",
    32: "EXIT_ZOMBIE",
    64: "TASK_PARKED",
    128: "TASK_DEAD",
}


def state_name(code: Column) -> Column:
    known = F.create_map(*(x for k, v in TASK_STATES.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.concat(F.lit("UNKNOWN(0x"), F.lower(F.hex(code)), F.lit(")")))


def decoded(raw: Column, fields: Column, little: bool = True) -> Column:
    """map of field -> unsigned value of a buffer by its layout, array<struct<field, byte_offset, byte_size>>.

    Fields of 1, 2, 4 or 8 bytes that lie wholly in the buffer; values are decimals, as eight bytes go beyond a long.
    """
    valued = F.transform(fields, lambda f: F.struct(f["field"].alias("field"), F.when(f["byte_offset"] >= 0, decode_unsigned(raw, f["byte_offset"], f["byte_size"], little)).alias("value")))
    return F.map_from_entries(F.filter(valued, lambda f: f["value"].isNotNull()))
