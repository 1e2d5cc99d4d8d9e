"""Binaries made by hand, byte by byte: functions, layouts and lines of DWARF 4 and 5."""

import struct

import pytest

from lodestone.sources import debug_info, dwarf


def uleb(n):
    out = b""
    while True:
        n, b = n >> 7, n & 127
        out += bytes([b | 128 if n else b])
        if not n:
            return out


def elf(sections, flags=0):
    """A 64-bit little-endian ELF file of these sections."""
    names, body, heads = b"\0", b"", [struct.pack("<IIQQQQIIQQ", *[0] * 10)]
    for name, data in [*sections.items(), (".shstrtab", None)]:
        at = len(names)
        names += name.encode() + b"\0"
        data = names if data is None else data
        heads.append(struct.pack("<IIQQQQIIQQ", at, 1, flags if name.startswith(".debug") else 0, 0, 64 + len(body), len(data), 0, 0, 1, 0))
        body += data
    head = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9)
    return head + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(heads), len(heads) - 1) + body + b"".join(heads)


class Strings:
    def __init__(self):
        self.data, self.at = b"\0", {}

    def __call__(self, text):
        if text not in self.at:
            self.at[text] = len(self.data)
            self.data += text.encode() + b"\0"
        return struct.pack("<I", self.at[text])


def abbrevs(*rows):
    out = b""
    for code, (tag, children, *spec) in enumerate(rows, 1):
        out += uleb(code) + uleb(tag) + bytes([children]) + b"".join(uleb(a) + uleb(f) for a, f in spec) + b"\0\0"
    return out + b"\0"


ABBREVS = abbrevs(
    (0x11, 1, (0x03, 0x0E), (0x10, 0x17)),  # 1 unit: name strp, stmt_list
    (0x2E, 0, (0x03, 0x0E), (0x11, 0x01), (0x12, 0x06), (0x3A, 0x0B), (0x3B, 0x05)),  # 2 function: high_pc is a length
    (0x2E, 0, (0x03, 0x08), (0x11, 0x01), (0x12, 0x01), (0x20, 0x0B)),  # 3 function: high_pc is an address, inline
    (0x2E, 0, (0x03, 0x08), (0x3C, 0x19), (0x11, 0x01), (0x12, 0x01)),  # 4 declaration
    (0x2E, 1, (0x11, 0x01), (0x12, 0x06)),  # 5 nameless function with children
    (0x24, 0, (0x03, 0x0E), (0x0B, 0x0B)),  # 6 base type
    (0x13, 1, (0x03, 0x0E), (0x0B, 0x0B)),  # 7 structure
    (0x13, 1, (0x0B, 0x0B)),  # 8 nameless structure
    (0x17, 1, (0x0B, 0x0B)),  # 9 nameless union
    (0x0D, 0, (0x03, 0x0E), (0x49, 0x13), (0x38, 0x0F)),  # 10 member
    (0x0D, 0, (0x49, 0x13), (0x38, 0x0F)),  # 11 nameless member
    (0x0D, 0, (0x03, 0x0E), (0x49, 0x13)),  # 12 member of a union, or a bit field
    (0x16, 0, (0x03, 0x0E), (0x49, 0x13)),  # 13 typedef
)


def unit(version, entries, strings):
    """A unit of (code, label, parts...); a part that is a tuple ('ref', label) is a type in the unit."""
    header = 11 if version == 4 else 12
    place, places = header, {}
    for code, label, *parts in entries:
        places[label] = place
        place += 1 + sum(4 if isinstance(p, tuple) else len(p) for p in parts) if code else 1
    body = b"".join(bytes([code]) + b"".join(struct.pack("<I", places[p[1]]) if isinstance(p, tuple) else p for p in parts) for code, _, *parts in entries)
    middle = struct.pack("<HIB", 4, 0, 8) if version == 4 else struct.pack("<HBBI", 5, 1, 8, 0)
    return struct.pack("<I", len(middle) + len(body)) + middle + body


def program_4(rows):
    files = b"/src/linux/mm\0include\0\0slab.c\0\1\0\0mm.h\0\2\0\0main.c\0\0\0\0\0"
    head = bytes([4, 1, 1, 0xFB, 14, 13, 0, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1]) + files
    return _program(struct.pack("<H", 4), head, rows)


def program_5(rows):
    folders = bytes([1, 1, 8, 2]) + b"/build/linux/net\0/usr/include\0"
    files = bytes([2, 1, 8, 2, 0x0B, 2]) + b"core.c\0\0stdio.h\0\1"
    head = bytes([1, 1, 1, 0xFB, 14, 13, 0, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1]) + folders + files
    return _program(struct.pack("<HBB", 5, 8, 0), head, rows)


def _program(start, head, operations):
    body = start + struct.pack("<I", len(head)) + head + operations
    return struct.pack("<I", len(body)) + body


def address(n):
    return b"\0\x09\x02" + struct.pack("<Q", n)


END = b"\0\1\1"
HIGH = 0xFFFFFFFF81000000


def made():
    s = Strings()
    first = program_4(
        address(HIGH)
        + bytes([1])  # copy: line 1
        + bytes([3, 10, 5, 7, 13 + 5 + 14 * 2])  # line 11, column 7, special: 2 * 4 bytes on, same line
        + bytes([6, 4, 2, 2, 3, 1])  # no statement, file 2, 3 * 4 bytes on, copy
        + bytes([8, 9, 2, 0, 1])  # (255 - 13) // 14 * 4 = 68 bytes on, then 2, copy
        + bytes([4, 9, 1])  # a file that isn't listed
        + bytes([2, 1])
        + END
        + address(0)
        + bytes([1])
        + END
    )
    second = program_5(address(0x1000) + bytes([4, 0, 1, 4, 1, 10, 12, 5, 1]) + END)
    u1 = unit(
        4,
        [
            (1, "root", s("/src/linux/mm/slab.c"), struct.pack("<I", 0)),
            (2, "f", s("kmalloc"), struct.pack("<QI", HIGH, 0x40), b"\1", struct.pack("<H", 300)),
            (2, "nofile", s("other"), struct.pack("<QI", HIGH + 0x40, 8), b"\x63", struct.pack("<H", 1)),
            (3, "g", b"kfree\0", struct.pack("<QQ", HIGH + 0x50, HIGH + 0x60), b"\1"),
            (3, "empty", b"nothing\0", struct.pack("<QQ", HIGH, HIGH), b"\0"),
            (3, "zero", b"at_zero\0", struct.pack("<QQ", 0, 8), b"\0"),
            (4, "decl", b"declared\0", struct.pack("<QQ", HIGH, HIGH + 8)),
            (5, "nameless", struct.pack("<QI", HIGH, 8)),
            (6, "int", s("int"), b"\4"),
            (0, "_end1"),
            (6, "long", s("long"), b"\10"),
            (13, "size", s("size_type"), ("ref", "long")),
            (7, "struct", s("page"), b"\50"),
            (10, "m1", s("flags"), ("ref", "int"), uleb(0)),
            (11, "m2", ("ref", "anon"), uleb(8)),
            (10, "m3", s("next"), ("ref", "struct"), uleb(24)),
            (10, "m4", s("count"), ("ref", "size"), uleb(200)),
            (12, "bits", s("bits"), ("ref", "int")),
            (0, "_end2"),
            (8, "anon", b"\20"),
            (10, "a1", s("private"), ("ref", "long"), uleb(0)),
            (11, "a2", ("ref", "union"), uleb(8)),
            (0, "_end3"),
            (9, "union", b"\10"),
            (12, "u1", s("index"), ("ref", "long")),
            (12, "u2", s("flags"), ("ref", "int")),
            (0, "_end4"),
            (0, "_end"),
        ],
        s,
    )
    u2 = unit(5, [(1, "root", s("net/core.c"), struct.pack("<I", len(first))), (2, "f", s("net_init"), struct.pack("<QI", 0x1000, 16), b"\1", struct.pack("<H", 5)), (0, "_end")], s)
    return {".debug_info": u1 + u2, ".debug_abbrev": ABBREVS, ".debug_str": s.data, ".debug_line": first + second}


@pytest.fixture(scope="module")
def binaries(tmp_path_factory):
    root = tmp_path_factory.mktemp("binaries")
    (root / "vmlinux").write_bytes(elf(made()))
    (root / "notes.txt").write_text("no binary")
    (root / "empty").write_bytes(b"")
    (root / "plain").write_bytes(elf({".text": b"\x90"}))
    return root


def test_functions(spark, binaries):
    """Named ones with an address; the ends are lengths or addresses; a file that isn't listed is the unit's."""
    rows = debug_info.functions(dwarf.read(spark, str(binaries), "functions")).collect()
    got = {(r["name"], int(r["addr_start"]), int(r["addr_end"]), r["source_file"], r["source_line"], r["symbol_type"]) for r in rows}
    assert len(rows) == 4 and got == {
        ("kmalloc", HIGH, HIGH + 0x40, "mm/slab.c", 300, "function"),
        ("other", HIGH + 0x40, HIGH + 0x48, "/src/linux/mm/slab.c", 1, "function"),
        ("kfree", HIGH + 0x50, HIGH + 0x60, "/src/linux/mm/slab.c", 0, "inline"),
        ("net_init", 0x1000, 0x1010, "usr/include/stdio.h", 5, "function"),
    }


def test_lines(spark, binaries):
    """Every way of moving on; ends, address 0 and unlisted files go."""
    all_rows = dwarf.read(spark, f"file://{binaries}/vmlinux", "lines")
    got = sorted((int(r["address"]), r["file_path"], r["line"], r["column"], r["is_stmt"]) for r in debug_info.lines(all_rows).collect())
    assert got == [
        (0x1000, "net/core.c", 1, 0, True),
        (0x1000, "usr/include/stdio.h", 1, 0, True),
        (HIGH, "mm/slab.c", 1, 0, True),
        (HIGH + 8, "mm/slab.c", 11, 7, True),
        (HIGH + 20, "include/mm.h", 11, 7, False),
        (HIGH + 20 + 68 + 2, "include/mm.h", 11, 7, False),
    ]
    assert all_rows.where("end_sequence").count() == 3


def test_layouts(spark, binaries):
    """Nameless members are flattened at their places, the outer of two names wins, bit fields go, a typedef states no size."""
    rows = debug_info.layouts(dwarf.read(spark, str(binaries), "members")).where("struct_name = 'page'").collect()
    assert {r["field"]: (r["byte_offset"], r["byte_size"], r["c_type"]) for r in rows} == {
        "flags": (0, 4, "int"), "private": (8, 8, "long"), "index": (16, 8, "long"), "next": (24, 40, "page"), "count": (200, 0, "size_type"),
    }


def test_units_are_dealt(spark, binaries):
    """A task a unit gives the same rows as one task for all."""
    path = str(binaries / "vmlinux")
    whole = {t: sorted(map(tuple, dwarf.read(spark, path, t).collect()), key=str) for t in dwarf.TABLES}
    apart = {t: spark.read.format("dwarf").options(path=path, table=t, unit_bytes=1).load() for t in dwarf.TABLES}
    assert len(dwarf.DwarfReader({"path": path, "unit_bytes": "1"}).partitions()) == 2 and apart["lines"].rdd.getNumPartitions() == 2
    assert {t: sorted(map(tuple, rows.collect()), key=str) for t, rows in apart.items()} == whole


def test_what_holds_nothing(spark, binaries, tmp_path):
    for name in ("notes.txt", "empty", "plain"):
        assert dwarf.read(spark, str(binaries / name), "functions").count() == 0
    with pytest.raises(Exception, match="no table 'types'"):
        dwarf.read(spark, str(binaries), "types").count()
    with pytest.raises(Exception, match="not_there"):
        dwarf.read(spark, str(tmp_path / "not_there"), "lines").count()
    (tmp_path / "packed").write_bytes(elf(made(), flags=0x800))
    with pytest.raises(Exception, match="compressed"):
        dwarf.read(spark, str(tmp_path / "packed"), "lines").count()


def test_cut_off(spark, tmp_path):
    parts = made()
    parts[".debug_line"] = parts[".debug_line"][:40]
    (tmp_path / "cut").write_bytes(elf(parts))
    with pytest.raises(Exception, match="ends early|subsection not found"):
        dwarf.read(spark, str(tmp_path / "cut"), "lines").count()


def test_cache(spark, binaries, tmp_path, monkeypatch):
    """The second read decodes nothing; another content or version does."""
    path, root = tmp_path / "vmlinux", str(tmp_path / "cache")
    path.write_bytes(elf(made()))
    read, decoded = dwarf.read, []
    monkeypatch.setattr(dwarf, "read", lambda *a: decoded.append(a[2]) or read(*a))
    cache = dwarf.Cache(spark, root)
    counts = {t: rows.count() for t, rows in cache.tables(str(path)).items()}
    assert sorted(decoded) == sorted(dwarf.TABLES) and counts == {t: read(spark, str(path), t).count() for t in dwarf.TABLES}
    assert {t: rows.count() for t, rows in dwarf.Cache(spark, root).tables(str(path)).items()} == counts and len(decoded) == 3
    path.write_bytes(elf({**made(), ".debug_line": made()[".debug_line"] + bytes(4)}))
    assert cache.tables(str(path))["functions"].count() == counts["functions"] and len(decoded) == 6
    dwarf.Cache(spark, root, version=2).tables(str(path))
    assert len(decoded) == 9
    with pytest.raises(FileNotFoundError):
        cache.tables(str(tmp_path))


def test_line_programs_of_rows(spark):
    """Programs in a table; nulls give nothing."""
    rows = spark.createDataFrame([("a", bytearray(program_4(address(16) + bytes([1]) + END))), ("b", None)], "unit string, program binary")
    got = [(r["unit"], int(r["address"]), r["file_path"], r["end_sequence"]) for r in dwarf.line_entries(rows).collect()]
    assert got == [("a", 16, "mm/slab.c", False), ("a", 16, "mm/slab.c", True)]
    assert dwarf.line_entries(rows.limit(0)).count() == 0
