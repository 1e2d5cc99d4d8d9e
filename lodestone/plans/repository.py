"""Queries over a repository that Spark derives from the documents: mining, proposals, snapshots, previews.

Every document is a C file with a function a line, ``int f0(void)`` and so on, four lines each, that holds
the line as a comment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.address import decoded
from lodestone.operators import mining, mod_store, proposals
from lodestone.operators.extraction import Cache
from lodestone.plans.workflows import sql
from lodestone.session import folder, table
from lodestone.sources import debug_info, dwarf

#: Lines of a function.
TALL = 4
_BASE = "base AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"


def _c_file(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    one = lambda line, i: F.concat(F.lit("int f"), i, F.lit("(void)\n{ // "), F.regexp_replace(line, r"\\", "/"), F.lit("\n\tuse("), i, F.lit(");\n}\n"))
    return F.array_join(F.transform(lines, one), "")


def _path(column: str = "doc_id") -> Column:
    return F.concat(F.lit("src/d"), column, F.lit(".c"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _path().alias("path"), _c_file(F.col("text")).alias("content"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))


# --- mining -------------------------------------------------------------------------------------


@sql(f"""WITH {_BASE}, c AS (SELECT a.doc_id AS id, b.n FROM base a JOIN base b ON b.doc_id = a.doc_id - a.doc_id % 3),
        h AS (SELECT id, unnest([id * 7 % (4 * n), id * 13 % (4 * n), id * 7 % (4 * n) + 1]) AS line FROM c),
        p AS (SELECT id, count(DISTINCT line // 4) AS k, string_agg(DISTINCT 'src/d' || id || '.c::f' || (line // 4), ',' ORDER BY 'src/d' || id || '.c::f' || (line // 4)) AS positives
              FROM (SELECT id, line FROM h JOIN c USING (id) WHERE line < 4 * n) GROUP BY id)
        SELECT 'c' || id AS "commit", 'mm: change number ' || id || ' of a document' AS query, CAST(DATE '2020-01-01' + CAST(id % 1000 AS INTEGER) AS VARCHAR) AS date, positives, 'mm' AS subsystem, 'src/d' || id || '.c' AS changed_files
        FROM p WHERE id % 11 <> 5""")
def mined_repository(spark: SparkSession, d: str) -> DataFrame:
    """Every document is a commit; three in a row share one blob. What is mined comes from the log, the diffs and the blobs alone."""
    files = _files(spark, d)
    own = files.select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.col("doc_id") % 3).alias("base"))
    shared = own.join(files.select(F.col("doc_id").alias("base"), "content", "n"), "base")
    sha, path, most = F.concat(F.lit("c"), "id"), _path("id"), F.col("n") * TALL
    tree, blobs = mining.blobs_of(shared.select(sha.alias("sha"), path.alias("file"), "content"))
    head = lambda line: F.concat(F.lit("@@ -1,3 +"), line + 1, F.lit(",3 @@\n context\n-old\n+new\n"))
    text = F.concat(head(F.col("id") * 7 % most), head(F.col("id") * 13 % most), head(F.col("id") * 7 % most + 1))
    diffs = shared.select(sha.alias("sha"), path.alias("file"), text.alias("text"))
    subject = F.when(F.col("id") % 11 == 5, "Merge branch of many changes").otherwise(F.concat(F.lit("mm: change number "), "id", F.lit(" of a document")))
    date = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1000).cast("int")).cast("string")
    log = own.select(F.concat_ws("\n", F.concat_ws("|", sha, date, subject), path, F.lit("README")).alias("value"))
    rows = mining.mined(log, diffs, tree, blobs, "2018-01-01", Cache(spark, folder(spark, "ranges")))
    return rows.withColumn("date", F.col("date").cast("string")).withColumn("positives", F.array_join("positives", ",")).withColumn("changed_files", F.array_join("changed_files", ","))


# --- proposals and snapshots ------------------------------------------------------------------------


def _line(number: int, text: Column) -> Column:
    return F.struct(F.lit(number).alias("line_no"), text.alias("text"))


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    """Two hunks of every even document, one of the others: f0 is called g0, and f1 uses another number."""
    first = F.struct(F.lit(0).alias("hunk"), F.lit(1).alias("at"), F.lit("int f0(void)").alias("old"), F.lit("int g0(void)").alias("new"))
    second = F.struct(F.lit(1).alias("hunk"), F.lit(7).alias("at"), F.lit("\tuse(1);").alias("old"), F.lit("\tuse(99);").alias("new"))
    each = _files(spark, d).select("doc_id", "path", F.explode(F.when((F.col("doc_id") % 2 == 0) & (F.col("n") > 1), F.array(first, second)).otherwise(F.array(first))).alias("h"))
    none = F.array().cast("array<string>")
    one = lambda c: F.array(F.struct(F.col("h.at").alias("line_no"), F.col(c).alias("text")))
    return each.select(F.concat(F.lit("m"), F.col("doc_id") % 7).alias("diff_id"), "h.hunk", F.col("path").alias("file_path"), F.col("h.at").alias("old_start"), F.col("h.at").alias("new_start"), none.alias("before_context"), one("h.old").alias("removed_lines"), one("h.new").alias("added_lines"), none.alias("after_context"))


@sql(f"""WITH {_BASE} SELECT 'src/d' || doc_id || '.c::f0' AS id, 'removed' AS change FROM base UNION ALL SELECT 'src/d' || doc_id || '.c::g0', 'new' FROM base
        UNION ALL SELECT 'src/d' || doc_id || '.c::f1', 'changed' FROM base WHERE doc_id % 2 = 0 AND n > 1""")
def preview_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What the hunks of all proposals would do to the nodes of the files that they touch."""
    return proposals.preview_nodes(_files(spark, d).select("path", "content"), _hunks(spark, d))


def _worked(spark: SparkSession, d: str) -> tuple[mod_store.ModStore, DataFrame, DataFrame]:
    """A store in which four of seven proposals were accepted and applied in two rounds, the files before, and after."""
    store = mod_store.ModStore(spark, folder(spark, "mods"))
    files = _files(spark, d).select("path", "content")
    store.propose(_hunks(spark, d), 1)
    now = files
    for at, ids in ((10, ["m0", "m1"]), (20, ["m2", "m3"])):
        store.put_state(spark.createDataFrame([(i,) for i in ids], "id string"), "accepted", at)
        now, _ = store.apply(now, at + 5)
    store.put_state(spark.createDataFrame([("m4",)], "id string"), "discarded", 30)
    return store, files, now


@sql("""WITH k AS (SELECT DISTINCT doc_id % 7 AS m FROM documents) SELECT 'm' || m AS id, CASE WHEN m < 4 THEN 'applied' WHEN m = 4 THEN 'discarded' ELSE 'proposed' END AS state FROM k""")
def mod_store_states(spark: SparkSession, d: str) -> DataFrame:
    """The proposals' states after two rounds."""
    return _worked(spark, d)[0].proposals()


_C_LINES = """list_transform(range(1, n + 1), lambda i: 'int ' || CASE WHEN i = 1 AND {renamed} THEN 'g0' ELSE 'f' || (i - 1) END || '(void)' || chr(10) || '{{ // ' || replace(l[i], '\\', '/') || chr(10) || chr(9) || 'use(' || CASE WHEN i = 2 AND doc_id % 2 = 0 AND {renamed} THEN 99 ELSE i - 1 END || ');' || chr(10) || '}}' || chr(10))"""


@sql(f"""WITH {_BASE} SELECT 'src/d' || doc_id || '.c' AS path, md5(array_to_string({_C_LINES.format(renamed="doc_id % 7 < 4")}, '')) AS content FROM base""")
def mod_store_applied(spark: SparkSession, d: str) -> DataFrame:
    """All files after two rounds of proposals."""
    return _worked(spark, d)[2].withColumn("content", F.md5("content"))


@sql(f"""WITH {_BASE} SELECT 'src/d' || doc_id || '.c' AS path, md5(array_to_string({_C_LINES.format(renamed="doc_id % 7 < 2 AND FALSE")}, '')) AS content FROM base""")
def mod_store_reverted(spark: SparkSession, d: str) -> DataFrame:
    """Reverted to the second snapshot, whose chain holds the first round's files by its parent: all files are as they were."""
    store, _, after = _worked(spark, d)
    return store.revert(after, max(store.snapshot_ids())).withColumn("content", F.md5("content"))


@sql(f"""WITH {_BASE} SELECT 1 AS id, NULL::INTEGER AS parent_id, CAST(15 AS BIGINT) AS "at", count(*) AS files FROM base WHERE doc_id % 7 < 2
        UNION ALL SELECT 2, 1, 25, count(*) FROM base WHERE doc_id % 7 < 4""")
def mod_store_history(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots, their parents, and how many files each can give back with its ancestors."""
    store, _, _ = _worked(spark, d)
    rows = None
    for n in store.snapshot_ids():  # a row a snapshot: two
        one = store.manifest(n).agg(F.count("*").alias("files")).withColumn("id", F.lit(n))
        rows = one if rows is None else rows.union(one)
    return store.history().join(rows, "id").select("id", "parent_id", "at", "files")


# --- layouts ------------------------------------------------------------------------------------------

_LAYOUT = [("flag", 0, 1), ("port", 1, 2), ("odd", 3, 3), ("size", 4, 4), ("next", 8, 8), ("beyond", 12, 8)]


def _little(offset: int, size: int) -> str:
    pairs = " || ".join(f"substr(h, {2 * (offset + i) + 1}, 2)" for i in reversed(range(size)))
    return f"CAST(CAST('0x' || {pairs} AS UBIGINT) AS VARCHAR)"


@sql("WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field, {_little(o, s)} AS value FROM m" for n, o, s in _LAYOUT if s in (1, 2, 4, 8) and o + s <= 16))
def struct_decode(spark: SparkSession, d: str) -> DataFrame:
    """The md5 of every document as the bytes of a structure: a field that isn't whole or no number is left out."""
    layout = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(o).alias("byte_offset"), F.lit(s).alias("byte_size")) for n, o, s in _LAYOUT))
    raw = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", F.explode(decoded(raw, layout)).alias("field", "value")).withColumn("value", F.col("value").cast("string"))


# --- line-number programs -------------------------------------------------------------------------------

#: Files of the programs, and what stands before their operations: DWARF 4, lines by -5 to 8, opcodes of the machine below 13.
_LINE_FILES = b"/src/linux/mm\0\0slab.c\0\x01\0\0\0"
_LINE_HEAD = bytes([1, 1, 1, 0xFB, 14, 13, 0, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1]) + _LINE_FILES
_LINE_SIZE = 2 + 4 + len(_LINE_HEAD) + 3 + 11 + 16 + 3


@sql("""WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents),
        o AS (SELECT doc_id, h, i, greatest(CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER), 13) - 13 AS op FROM m, unnest(range(16)) AS t(i)),
        s AS (SELECT doc_id, i, CAST('0x' || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) + CAST(sum(op // 14) OVER w AS BIGINT) AS a,
                     CAST(1001 + sum(op % 14 - 5) OVER w AS INTEGER) AS line FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i))
        SELECT CAST(doc_id AS VARCHAR) AS unit, CAST(a AS VARCHAR) AS address, 'mm/slab.c' AS file_path, line, 0 AS "column", TRUE AS is_stmt FROM s WHERE a > 0""")
def line_program(spark: SparkSession, d: str) -> DataFrame:
    """The md5 of every document as a line-number program: its bytes are special operations, its first six the address at which they begin."""
    h = F.md5(F.coalesce("text", F.lit("")))
    pairs = [F.substring(h, 2 * i + 1, 2) for i in range(16)]
    ops = F.concat(*(F.when(p < "0d", "0d").otherwise(p) for p in pairs))
    head = _LINE_SIZE.to_bytes(4, "little") + bytes([4, 0]) + len(_LINE_HEAD).to_bytes(4, "little") + _LINE_HEAD
    # 03: a thousand lines on; 00 09 02: the address; 00 01 01: the end of the sequence.
    program = F.unhex(F.concat(F.lit(head.hex() + "03e807" + "000902"), *pairs[:6], F.lit("0000"), ops, F.lit("000101")))
    rows = debug_info.lines(dwarf.line_entries(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit"), program.alias("program"))))
    return rows.select("unit", F.col("address").cast("string").alias("address"), "file_path", "line", "column", "is_stmt")
