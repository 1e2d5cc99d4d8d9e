"""Debugging information of binaries (ELF; DWARF 2 to 5) as a Spark data source.

    spark.dataSource.register(DwarfSource)
    spark.read.format("dwarf").option("path", uri).option("table", "functions").load()

Tables: ``functions`` (debug_info.BINARY_SYMBOL), ``members`` (debug_info.MEMBER) and ``lines``
(debug_info.LINE_ENTRY), rows as ``debug_info`` takes them.  A task reads whole compilation units, by
range, up to ``unit_bytes`` (32 MB) of them: the driver walks the units' headers only, and nothing holds a
file.  What a table doesn't need isn't decoded: functions read no line program but its list of files, lines
no unit beyond its first entry.

A path is a file or a folder, of any file system that pyarrow opens.  Files that aren't ELF, or hold no
debugging information, give no rows; compressed sections raise ValueError.  Types of other units
(LTO, type units) are not looked up: their members have the type 'unknown' and size 0, as have those without
a type; so have nameless ones, which are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import suppress
from decimal import Decimal
from functools import lru_cache

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.publish import Folder, Taken
from lodestone.sources.debug_info import BINARY_SYMBOL, LINE_ENTRY, MEMBER

#: Rows that a task hands over at a time.
BATCH = 20_000
TABLES = {"functions": BINARY_SYMBOL, "members": MEMBER, "lines": LINE_ENTRY}

# Numbers of the DWARF standard.
UNIT, SUBPROGRAM, STRUCT, UNION, MEMBER_TAG = 0x11, 0x2E, 0x13, 0x17, 0x0D
NAME, BYTE_SIZE, STMT_LIST, LOW_PC, HIGH_PC, INLINE, LOCATION, DECL_FILE, DECL_LINE, DECLARATION, TYPE, STR_BASE, ADDR_BASE = 0x03, 0x0B, 0x10, 0x11, 0x12, 0x20, 0x38, 0x3A, 0x3B, 0x3C, 0x49, 0x72, 0x73
#: Bytes of the forms that have a fixed number of them; A: an address, O: an offset.
SIZES = {0x01: "A", 0x05: 2, 0x06: 4, 0x07: 8, 0x0B: 1, 0x0C: 1, 0x0E: "O", 0x10: "O", 0x11: 1, 0x12: 2, 0x13: 4, 0x14: 8, 0x17: "O", 0x1C: 4, 0x1D: "O", 0x1F: "O", 0x20: 8, 0x24: 8, 0x25: 1, 0x26: 2, 0x27: 3, 0x28: 4, 0x29: 1, 0x2A: 2, 0x2B: 3, 0x2C: 4, 0x1F20: "O", 0x1F21: "O"}
#: Bytes before a block of the form.
BLOCKS = {0x0A: 1, 0x03: 2, 0x04: 4}
STRX, ADDRX, UNIT_REFS = {0x1A, 0x25, 0x26, 0x27, 0x28}, {0x1B, 0x29, 0x2A, 0x2B, 0x2C}, {0x11, 0x12, 0x13, 0x14, 0x15}


class Cursor:
    """Numbers and strings of bytes, in order."""

    def __init__(self, data: bytes, at: int = 0, order: str = "little", wide: bool = False, address: int = 8):
        self.data, self.at, self.order, self.offset_size, self.address = data, at, order, 8 if wide else 4, address

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("debugging information ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        return int.from_bytes(self.raw(n), self.order)

    def leb(self, signed: bool = False) -> int:
        value, shift = 0, 0
        while True:
            b = self.u(1)
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value - (1 << shift) if signed and b & 64 else value

    def text(self) -> str:
        end = self.data.index(0, self.at)
        found, self.at = self.data[self.at : end], end + 1
        return found.decode("utf-8", "replace")

    def form(self, form: int, const: int = 0):
        if form in SIZES:
            size = SIZES[form]
            return self.u(self.address if size == "A" else self.offset_size if size == "O" else size)
        if form in BLOCKS:
            return self.raw(self.u(BLOCKS[form]))
        match form:
            case 0x08:
                return self.text()
            case 0x09 | 0x18:
                return self.raw(self.leb())
            case 0x0D:
                return self.leb(True)
            case 0x0F | 0x15 | 0x1A | 0x1B | 0x22 | 0x23:
                return self.leb()
            case 0x16:
                return self.form(self.leb())
            case 0x19:
                return 1
            case 0x1E:
                return self.raw(16)
            case 0x21:
                return const
        raise ValueError(f"unknown form {form:#x}")


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Binary:
    """An ELF file's debugging sections, read by range; blocks of a megabyte are kept, 32 of them at most."""

    BLOCK = 1 << 20

    def __init__(self, uri: str):
        fs, path = located(uri)
        self._file = fs.open_input_file(path)
        self._block = lru_cache(32)(lambda i: self._file.read_at(self.BLOCK, i * self.BLOCK))
        self.sections = self._sections()

    def _read(self, at: int, n: int) -> bytes:
        if n > self.BLOCK:
            return self._file.read_at(n, at)
        first, last = at // self.BLOCK, (at + n - 1) // self.BLOCK if n else at // self.BLOCK
        return b"".join(self._block(i) for i in range(first, last + 1))[at - first * self.BLOCK :][:n]

    def _sections(self) -> dict[str, tuple[int, int]]:
        """Name -> (place, size); empty if this is no ELF file."""
        ident = self._read(0, 16)
        if ident[:4] != b"\x7fELF":
            return {}
        big = ident[4] == 2
        self.order = "little" if ident[5] == 1 else "big"
        sign = "<" if self.order == "little" else ">"
        places = struct.unpack(sign + ("40xQ10xHHH" if big else "32xI10xHHH"), self._read(0, 64 if big else 52))
        if not places[0] or not places[2]:
            return {}
        heads = [struct.unpack(sign + ("IIQQQQ" if big else "IIIIII"), self._read(places[0] + i * places[1], 40 if big else 24)) for i in range(places[2])]
        names = self._read(heads[places[3]][4], heads[places[3]][5])
        found = {}
        for name, _, flags, _, at, size in heads:
            label = names[name : names.index(b"\0", name)].decode()
            if label.startswith((".debug_", ".zdebug_")):
                if label.startswith(".z") or flags & 0x800:
                    raise ValueError(f"{label} is compressed")
                found[label] = (at, size)
        return found

    def part(self, section: str, at: int, n: int) -> bytes:
        start, size = self.sections[section]
        return self._read(start + at, max(0, min(n, size - at)))

    def string(self, section: str, at: int) -> str:
        got, step = b"", 64
        while b"\0" not in got:
            more = self.part(section, at + len(got), step)
            if not more:
                raise ValueError(f"no string at {at} of {section}")
            got, step = got + more, step * 4
        return got[: got.index(b"\0")].decode("utf-8", "replace")

    def units(self) -> Iterator[tuple[int, int]]:
        """(place, size) of every unit of .debug_info, its length field included."""
        at, end = 0, self.sections.get(".debug_info", (0, 0))[1]
        while at < end:
            size = self.length(".debug_info", at)
            yield at, size
            at += size

    def length(self, section: str, at: int) -> int:
        """Size of what starts at ``at`` with its length, that field included."""
        c = Cursor(self.part(section, at, 12), 0, self.order)
        n = c.u(4)
        return c.u(8) + 12 if n == 0xFFFFFFFF else n + 4


class Unit:
    """A compilation unit."""

    def __init__(self, binary: Binary, place: int, size: int):
        self.binary, self.place = binary, place
        self.cursor = c = Cursor(binary.part(".debug_info", place, size), 0, binary.order)
        if c.u(4) == 0xFFFFFFFF:
            c.offset_size = 8
            c.u(8)
        self.version, self.kind = c.u(2), 1
        if self.version >= 5:
            self.kind, c.address, abbrevs = c.u(1), c.u(1), c.u(c.offset_size)
            c.raw({4: 8, 5: 8, 2: 8 + c.offset_size, 6: 8 + c.offset_size}.get(self.kind, 0))
        else:
            abbrevs, c.address = c.u(c.offset_size), c.u(1)
        self.abbrevs = self._abbrevs(abbrevs)
        self.first, self.root = c.at, {}
        self.root = next((a for _, _, _, a in self.entries()), {})

    def _abbrevs(self, at: int) -> dict[int, tuple[int, bool, list[tuple[int, int, int]]]]:
        """code -> (tag, has children, (attribute, form, constant)...)."""
        size = 4096
        while True:
            c, found = Cursor(self.binary.part(".debug_abbrev", at, size)), {}
            try:
                while code := c.leb():
                    tag, children, spec = c.leb(), bool(c.u(1)), []
                    while True:
                        name, form = c.leb(), c.leb()
                        if not name and not form:
                            break
                        spec.append((name, form, c.leb(True) if form == 0x21 else 0))
                    found[code] = (tag, children, spec)
                return found
            except ValueError:
                if len(c.data) < size:
                    return found  # the section ends without a zero
                size *= 4

    def entries(self) -> Iterator[tuple[int, int | None, int, dict[int, tuple[int, object]]]]:
        """place in the unit, its parent's, tag, attributes (number -> form, value)."""
        c, above = self.cursor, []
        c.at = self.first
        while c.at < len(c.data):
            place, code = c.at, c.leb()
            if not code:
                if above:
                    above.pop()
                if not above:
                    return
                continue
            tag, children, spec = self.abbrevs[code]
            yield place, above[-1] if above else None, tag, {name: (form, c.form(form, const)) for name, form, const in spec}
            if children:
                above.append(place)
            elif not above:
                return

    def string(self, pair: tuple[int, object] | None) -> str | None:
        if pair is None:
            return None
        form, value = pair
        if form in STRX:
            c = self.cursor
            start = self.root[STR_BASE][1] if STR_BASE in self.root else 2 * c.offset_size
            value = int.from_bytes(self.binary.part(".debug_str_offsets", start + value * c.offset_size, c.offset_size), c.order)
            form = 0x0E
        return value if isinstance(value, str) else self.binary.string(".debug_line_str" if form == 0x1F else ".debug_str", value)

    def address(self, pair: tuple[int, object]) -> int:
        form, value = pair
        if form not in ADDRX:
            return value
        size, start = self.cursor.address, self.root[ADDR_BASE][1] if ADDR_BASE in self.root else 8
        return int.from_bytes(self.binary.part(".debug_addr", start + value * size, size), self.cursor.order)

    def program(self) -> LineProgram | None:
        if STMT_LIST not in self.root or ".debug_line" not in self.binary.sections:
            return None
        at = self.root[STMT_LIST][1]
        return LineProgram(self.binary.part(".debug_line", at, self.binary.length(".debug_line", at)), self.cursor.order, self.binary.string)


def file_path(folder: str, name: str) -> str:
    """The path below the source tree's root."""
    full = f"{folder}/{name}" if folder else name
    _, below, rest = full.partition("/linux/")
    return rest if below else full.lstrip("/")


class LineProgram:
    """A unit's table of files and the state machine that gives its rows."""

    def __init__(self, data: bytes, order: str = "little", string=None):
        self.cursor = c = Cursor(data, 0, order)
        if c.u(4) == 0xFFFFFFFF:
            c.offset_size = 8
            c.u(8)
        self.version = c.u(2)
        if self.version >= 5:
            c.address = c.u(1)
            c.raw(1)
        head = c.u(c.offset_size)
        self.start = c.at + head
        self.min_size, self.most_ops = c.u(1), c.u(1) if self.version >= 4 else 1
        self.default_stmt, base, self.line_range, opcode_base = bool(c.u(1)), c.u(1), c.u(1), c.u(1)
        self.line_base = base - 256 if base > 127 else base
        self.operands = [0, *c.raw(opcode_base - 1)]
        self.files = self._new_files(string) if self.version >= 5 else self._old_files()

    def _old_files(self) -> dict[int, str]:
        c, folders, found = self.cursor, [""], {}
        while name := c.text():
            folders.append(name)
        while name := c.text():
            folder, _, _ = c.leb(), c.leb(), c.leb()
            found[len(found) + 1] = file_path(folders[folder] if folder < len(folders) else "", name)
        return found

    def _new_files(self, string) -> dict[int, str]:
        def listed() -> list[dict[int, object]]:
            form = [(c.leb(), c.leb()) for _ in range(c.u(1))]
            return [{kind: (f, c.form(f)) for kind, f in form} for _ in range(c.leb())]

        def said(pair) -> str:
            return pair[1] if isinstance(pair[1], str) else string(".debug_line_str" if pair[0] == 0x1F else ".debug_str", pair[1])

        c = self.cursor
        folders = [said(row[1]) for row in listed()]
        return {i: file_path(folders[row[2][1]] if 2 in row and row[2][1] < len(folders) else "", said(row[1])) for i, row in enumerate(listed())}

    def rows(self) -> Iterator[tuple[int, str | None, int, int, bool, bool]]:
        """address, file_path, line, column, is_stmt, end_sequence."""
        c, base = self.cursor, len(self.operands)
        c.at = self.start
        address, index, file, line, column, stmt = 0, 0, 1, 1, 0, self.default_stmt

        def moved(steps: int) -> tuple[int, int]:
            ops = index + steps
            return address + self.min_size * (ops // self.most_ops), ops % self.most_ops

        while c.at < len(c.data):
            op = c.u(1)
            if op >= base:
                steps, more = divmod(op - base, self.line_range)
                (address, index), line = moved(steps), line + self.line_base + more
                yield address, self.files.get(file), line, column, stmt, False
            elif op == 0:
                size = c.leb()
                end = c.at + size
                kind = c.u(1)
                if kind == 1:
                    yield address, self.files.get(file), line, column, stmt, True
                    address, index, file, line, column, stmt = 0, 0, 1, 1, 0, self.default_stmt
                elif kind == 2:
                    address, index = c.u(size - 1), 0
                elif kind == 3:
                    name, folder = c.text(), c.leb()
                    self.files[len(self.files) + 1] = name if not folder else file_path("", name)
                c.at = end
            elif op == 1:
                yield address, self.files.get(file), line, column, stmt, False
            elif op == 2:
                address, index = moved(c.leb())
            elif op == 3:
                line += c.leb(True)
            elif op == 4:
                file = c.leb()
            elif op == 5:
                column = c.leb()
            elif op == 6:
                stmt = not stmt
            elif op == 8:
                address, index = moved((255 - base) // self.line_range)
            elif op == 9:
                address, index = address + c.u(2), 0
            else:  # 7, 10, 11, 12 and what later versions may add: only their operands matter here
                for _ in range(self.operands[op]):
                    c.leb()


def _functions(unit: Unit) -> Iterator[tuple]:
    files, own = None, unit.string(unit.root.get(NAME)) or ""
    for _, _, tag, a in unit.entries():
        if tag != SUBPROGRAM or NAME not in a or LOW_PC not in a or DECLARATION in a:
            continue
        low = unit.address(a[LOW_PC])
        high = low
        if HIGH_PC in a:
            form, value = a[HIGH_PC]
            high = unit.address(a[HIGH_PC]) if form == 0x01 or form in ADDRX else low + value
        if files is None:
            program = unit.program()
            files = program.files if program else {}
        place = files.get(a[DECL_FILE][1], own) if DECL_FILE in a else own
        kind = "inline" if a.get(INLINE, (0, 0))[1] in (1, 3) else "function"
        yield unit.string(a[NAME]), Decimal(low), Decimal(high), ".text", place, a[DECL_LINE][1] if DECL_LINE in a else 0, kind, 0


def _members(unit: Unit) -> Iterator[tuple]:
    """Members of named structures, and those of nameless types under a key of their own (#file section's place)."""
    holders: dict[int, tuple[int, str | None]] = {}
    types: dict[int, tuple[int, str | None, int]] = {}
    members = []
    for place, above, tag, a in unit.entries():
        if tag == MEMBER_TAG:
            members.append((above, a))
        elif NAME in a or BYTE_SIZE in a:
            size = a[BYTE_SIZE][1] if BYTE_SIZE in a and isinstance(a[BYTE_SIZE][1], int) else 0
            types[place] = (tag, unit.string(a.get(NAME)), size)
            if tag in (STRUCT, UNION) and DECLARATION not in a:
                holders[place] = types[place]

    def key(place: int) -> str:
        tag, name, _ = holders[place]
        return name if name and tag == STRUCT else f"#{unit.place + place}"

    for above, a in members:
        if above not in holders:
            continue
        location = a.get(LOCATION, (0, 0 if holders[above][0] == UNION else None))[1]
        if not isinstance(location, int):
            continue  # a bit field, or a place that has to be computed
        form, at = a.get(TYPE, (0, -1))
        at = at if form in UNIT_REFS else -1
        name = unit.string(a.get(NAME)) or ""
        if name:
            _, kind, size = types.get(at, (0, None, 0))
            yield key(above), name, kind or "unknown", location, size
        elif at in holders:
            yield key(above), "", key(at), location, holders[at][2]


def _lines(unit: Unit) -> Iterator[tuple]:
    program = unit.program()
    for address, *rest in program.rows() if program else ():
        yield Decimal(address), *rest


_READ = {"functions": _functions, "members": _members, "lines": _lines}


class Units(InputPartition):
    """Units of a file that a task reads: from ``start`` to ``end`` of its section."""

    def __init__(self, uri: str, start: int, end: int):
        super().__init__((uri, start, end))
        self.uri, self.start, self.end = uri, start, end


class DwarfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.most = options["path"], options.get("table", "functions"), int(options.get("unit_bytes", 32 << 20))

    def _files(self) -> list[str]:
        fs, path = located(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            return [self.path]
        root = self.path[: self.path.index(path)] if "://" in self.path else ""
        return sorted(root + f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File)

    def partitions(self) -> list[Units]:
        found = []
        for uri in self._files():
            start = end = 0
            for at, size in Binary(uri).units():
                if at > start and at + size - start > self.most:
                    found.append(Units(uri, start, at))
                    start = at
                end = at + size
            if end > start:
                found.append(Units(uri, start, end))
        return found or [Units(self.path, 0, 0)]

    def read(self, part: Units) -> Iterator[tuple]:
        if part.start == part.end:
            return
        binary, at = Binary(part.uri), part.start
        while at < part.end:
            size = binary.length(".debug_info", at)
            unit = Unit(binary, at, size)
            if unit.kind == 1:  # whole compilation units; type, partial and split ones hold no code of their own
                yield from _READ[self.table](unit)
            at += size


class DwarfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dwarf"

    def schema(self) -> str:
        if (table := self.options.get("table", "functions")) not in TABLES:
            raise ValueError(f"no table {table!r}: {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> DwarfReader:
        return DwarfReader(self.options)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the binaries at ``path``."""
    spark.dataSource.register(DwarfSource)
    return spark.read.format("dwarf").option("path", path).option("table", table).load()


class Cache:
    """Tables of binaries below a folder: a binary is decoded once, by whoever is first.

    It is known by its size, its time of change and the CRC of its first 64 KiB; what another
    version of this module has kept isn't read.
    """

    VERSION = 1

    def __init__(self, spark: SparkSession, root: str, version: int = VERSION):
        self.spark, self.folder, self.version = spark, Folder(spark, root), version

    def key(self, uri: str) -> str:
        fs, path = located(uri)
        info = fs.get_file_info(path)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(uri)
        with fs.open_input_file(path) as f:
            return f"v{self.version}-{info.size:x}-{info.mtime_ns or 0:x}-{zlib.crc32(f.read_at(1 << 16, 0)):08x}"

    def tables(self, uri: str) -> dict[str, DataFrame]:
        """name -> rows, as ``read`` gives them."""
        key = self.key(uri)
        if not self.folder.exists(key):
            with suppress(Taken):
                self.folder.publish(key, {name: read(self.spark, uri, name) for name in TABLES})
        return {name: self.folder.read([key], name, schema) for name, schema in TABLES.items()}


def line_entries(programs: DataFrame) -> DataFrame:
    """unit and the line rows of line-number programs (unit string, program binary) that name their files themselves (DWARF 2 to 4, or 5 with strings inside)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows = ["unit", *(c.split()[0] for c in LINE_ENTRY.split(", "))], []
        for batch in batches:
            for unit, data in zip(batch["unit"], batch["program"], strict=True):
                for address, *rest in LineProgram(bytes(data)).rows() if data is not None else ():
                    rows.append((unit, Decimal(address), *rest))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return programs.select("unit", "program").mapInPandas(run, f"unit string, {LINE_ENTRY}")
