"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat_format, huffman, licenses, prefix_trie
from lodestone.llm.ann import ann_topk
from lodestone.llm.branch_merge import Edit, Editor, merge_edits
from lodestone.llm.exact_topk import exact_topk
from lodestone.llm.jaccard import jaccard_classes
from lodestone.llm.langid import language_id
from lodestone.llm.mixing import mix
from lodestone.llm.packing import pack
from lodestone.llm.scratch import table
from lodestone.llm.sharding import shard
from lodestone.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in four arrivals, compacted after each, and read back from the last manifest."""
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text of documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every 50th vector, by integer inner product."""
    return exact_topk(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op6_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Huffman blocks in doc_id order, and read back."""
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources have shares as the square roots of their bytes, shuffled."""
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return rows.withColumnsRenamed({"_copy": "copy", "_copies": "copies", "_order": "shuffle_key"})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    return language_id(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every 20th vector, by inner product."""
    return ann_topk(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the template's own markers, formatted, written and read back."""
    own = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat_format.round_trip(turns, public_tokenizers.path("byte_bpe_50k.json"))


def coded_edits(branch: str, added: int) -> Editor:
    """The edits of a branch that the crc32 of "branch:doc_id:name" modulo 17 decides; a row of code 3 or 4 adds row ``added`` - doc_id."""

    def edit(doc_id: int | None, cells: list[str], lines: list[str]) -> Edit:
        seed = zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:".encode())
        code = lambda name: zlib.crc32(name, seed) % 17
        row = code(b"row")
        new = [("", f"{c}!", f"{c}?")[k] if (k := code(name)) < 3 else c for c, name in zip(cells, (b"lang", b"source"), strict=True)]
        leaves = []
        for i, line in enumerate(lines):
            k = code(b"%d" % i)
            if k < 3:
                leaves.append((2 * i, (None, f"{line}!", f"{line}?")[k]))
            elif k < 5:
                leaves.append((2 * i + 1, "!?"[k - 3]))
        return Edit(row == 0, new, leaves, [(added - doc_id, cells, "!?"[row - 3])] if row in (3, 4) and doc_id is not None else [])

    return edit


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches L and R of documents, merged."""
    rows = merge_edits(table(spark, sf_dir, "documents"), coded_edits("L", -1), coded_edits("R", -5))
    return rows.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each with its head taken from the first of its hundred."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_exact_topk": op5_exact_topk,
    "op6_huffman": op6_huffman,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_ann": op10_ann,
    "op11_chat_format": op11_chat_format,
    "op12_branch_merge": op12_branch_merge,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": "SELECT doc_id, source, lang, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
    "op3_license_scan": licenses.oracle(),
    "op7_mixing": """
        WITH RECURSIVE sizes AS (
            SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source
        ), total AS (
            SELECT CAST(sum(bytes) AS DOUBLE) AS everything, CAST(sum(CAST(round(sqrt(CAST(bytes AS DOUBLE)), 4) AS DECIMAL(38, 4))) AS DOUBLE) AS targets FROM sizes
        ), rates AS (
            SELECT source, round(sqrt(CAST(bytes AS DOUBLE)), 4) / targets * everything / bytes AS rate FROM sizes, total
        ), below AS (
            SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
            UNION ALL
            SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM below
            WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
        ), numbers AS (
            SELECT doc_id, text, lang, source, n_chars,
                   (CAST(CAST('0x' || substr(md5('7:' || doc_id || ':' || md5(text)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
            FROM documents
        ), counted AS (
            SELECT n.doc_id, n.text, n.lang, n.source, n.n_chars, CAST(count(*) AS INTEGER) AS copies
            FROM numbers n JOIN below b ON n.source = b.source AND b.c < n.u
            GROUP BY ALL
        ), each AS (
            SELECT *, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy FROM counted
        )
        SELECT doc_id, text, lang, source, n_chars, copies, copy,
               CAST('0x' || substr(md5('7:' || doc_id || ':' || md5(text) || ':' || copy || ':order'), 1, 15) AS BIGINT) AS shuffle_key
        FROM each
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e
            FROM embeddings WHERE embedding IS NOT NULL
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(17 + length(role) + length(text)
                        + len(regexp_extract_all(role || chr(10) || text, '(?:\\[\\\\*/?INST\\]|<\\\\*/s>|<\\\\*\\|endoftext\\|>)'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op12_branch_merge": """
        WITH RECURSIVE steps AS (
            SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
            UNION ALL
            SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
        ), bytes AS (
            SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8
        ), base AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), names AS (
            SELECT doc_id, unnest(['row', 'lang', 'source']) AS name FROM base
            UNION ALL
            SELECT doc_id, CAST(unnest(range(len(lines))) AS VARCHAR) FROM base
        ), codes AS (
            SELECT b.branch, n.doc_id, n.name,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(b.branch || ':' || n.doc_id || ':' || n.name, ''), lambda x: CAST(ord(x) AS BIGINT))),
                       lambda c, x: xor(c // 256, crc[CAST(xor(c, x) % 256 AS BIGINT) + 1])), 4294967295) % 17 AS code
            FROM names n, (SELECT unnest(['L', 'R']) AS branch) b, bytes
        ), pairs AS (
            SELECT l.doc_id, l.name, l.code AS l, r.code AS r
            FROM codes l JOIN codes r ON l.branch = 'L' AND r.branch = 'R' AND l.doc_id = r.doc_id AND l.name = r.name
        ), cells AS (
            SELECT p.doc_id, p.name, v.value,
                   CASE p.l WHEN 0 THEN '' WHEN 1 THEN v.value || '!' WHEN 2 THEN v.value || '?' ELSE v.value END AS l,
                   CASE p.r WHEN 0 THEN '' WHEN 1 THEN v.value || '!' WHEN 2 THEN v.value || '?' ELSE v.value END AS r
            FROM pairs p JOIN (SELECT doc_id, 'lang' AS name, lang AS value FROM base UNION ALL SELECT doc_id, 'source', source FROM base) v USING (doc_id, name)
        ), lines AS (
            SELECT p.doc_id, CAST(p.name AS BIGINT) AS i, b.lines[CAST(p.name AS BIGINT) + 1] AS line, p.l, p.r
            FROM pairs p JOIN base b USING (doc_id) WHERE p.name NOT IN ('row', 'lang', 'source')
        ), leaves AS (
            SELECT doc_id, i, 0 AS gap, line, CASE WHEN l < 3 THEN l END AS l, CASE WHEN r < 3 THEN r END AS r FROM lines
            UNION ALL
            SELECT doc_id, i, 1, NULL, CASE WHEN l IN (3, 4) THEN l - 2 END, CASE WHEN r IN (3, 4) THEN r - 2 END FROM lines
        ), chosen AS (
            SELECT doc_id, i, gap,
                   CASE coalesce(l, r, 9) WHEN 9 THEN line WHEN 0 THEN NULL WHEN 1 THEN coalesce(line, '') || '!' WHEN 2 THEN coalesce(line, '') || '?' END AS merged,
                   CASE coalesce(l, 9) WHEN 9 THEN line WHEN 0 THEN NULL WHEN 1 THEN coalesce(line, '') || '!' WHEN 2 THEN coalesce(line, '') || '?' END AS ours,
                   l IS NOT NULL AS l_changed, r IS NOT NULL AS r_changed,
                   l IS NOT NULL AND r IS NOT NULL AND l <> r AS conflict, l = 0 OR r = 0 AS drops
            FROM leaves
        ), texts AS (
            SELECT doc_id, string_agg(merged, chr(10) ORDER BY i, gap) AS merged, string_agg(ours, chr(10) ORDER BY i, gap) AS ours,
                   bool_or(l_changed) AS l_changed, bool_or(r_changed) AS r_changed,
                   count(*) FILTER ((l_changed OR r_changed) AND NOT conflict) AS clean, count(*) FILTER (conflict AND gap = 0 AND NOT drops) AS ee,
                   count(*) FILTER (conflict AND gap = 0 AND drops) AS ed, count(*) FILTER (conflict AND gap = 1) AS ii
            FROM chosen GROUP BY doc_id
        ), columns AS (
            SELECT doc_id, max(CASE WHEN l <> value THEN l ELSE r END) FILTER (name = 'lang') AS lang, max(CASE WHEN l <> value THEN l ELSE r END) FILTER (name = 'source') AS source,
                   max(l) FILTER (name = 'lang') AS l_lang, max(l) FILTER (name = 'source') AS l_source,
                   bool_or(l <> value) AS l_changed, bool_or(r <> value) AS r_changed,
                   count(*) FILTER ((l <> value OR r <> value) AND (l = value OR r = value OR l = r)) AS clean,
                   count(*) FILTER (l <> value AND r <> value AND l <> r) AS ee
            FROM cells GROUP BY doc_id
        ), rows AS (
            SELECT t.doc_id, p.l = 0 AS l_gone, p.r = 0 AS r_gone, t.l_changed OR c.l_changed AS l_changed, t.r_changed OR c.r_changed AS r_changed,
                   c.lang, c.source, c.l_lang, c.l_source, coalesce(t.merged, '') AS merged, coalesce(t.ours, '') AS ours,
                   t.clean + c.clean AS clean, t.ee + c.ee AS ee, t.ed, t.ii
            FROM texts t JOIN columns c USING (doc_id) JOIN pairs p ON p.doc_id = t.doc_id AND p.name = 'row'
        ), kept AS (
            SELECT *, NOT l_gone AND NOT r_gone AS stays, NOT l_gone AND r_gone AND l_changed AS by_left,
                   (l_gone AND NOT r_gone AND r_changed) OR (r_gone AND NOT l_gone AND l_changed) AS conflict
            FROM rows
        ), added AS (
            SELECT CASE branch WHEN 'L' THEN -1 ELSE -5 END - c.doc_id AS doc_id, branch, b.lang, b.source, CASE code WHEN 3 THEN '!' ELSE '?' END AS text
            FROM codes c JOIN base b USING (doc_id) WHERE name = 'row' AND code IN (3, 4)
        ), news AS (
            SELECT doc_id, coalesce(l.lang, r.lang) AS lang, coalesce(l.source, r.source) AS source, coalesce(l.text, r.text) AS text,
                   coalesce(l.lang <> r.lang OR l.source <> r.source OR l.text <> r.text, false) AS conflict
            FROM (SELECT * FROM added WHERE branch = 'L') l FULL JOIN (SELECT * FROM added WHERE branch = 'R') r USING (doc_id)
        )
        SELECT doc_id, CASE WHEN stays THEN lang WHEN by_left THEN l_lang END AS lang, CASE WHEN stays THEN source WHEN by_left THEN l_source END AS source,
               CASE WHEN stays THEN sha256(merged) WHEN by_left THEN sha256(ours) END AS text_sha256,
               CAST(CASE WHEN stays THEN clean WHEN conflict THEN 0 ELSE 1 END AS BIGINT) AS n_clean, CAST(CASE WHEN stays THEN ee ELSE 0 END AS BIGINT) AS n_edit_edit,
               CAST(CASE WHEN stays THEN ed WHEN conflict THEN 1 ELSE 0 END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN stays THEN ii ELSE 0 END AS BIGINT) AS n_insert_insert
        FROM kept
        UNION ALL
        SELECT doc_id, lang, source, sha256(text), CAST(NOT conflict AS BIGINT), 0, 0, CAST(conflict AS BIGINT) FROM news
    """,
    "op13_prefix_trie": """
        WITH RECURSIVE steps AS (
            SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
            UNION ALL
            SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
        ), bytes AS (
            SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8
        ), own AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), heads AS (
            SELECT o.conv_id, o.turns, b.turns AS others,
                   xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(o.conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                       lambda c, x: xor(c // 256, crc[CAST(xor(c, x) % 256 AS BIGINT) + 1])), 4294967295) % 6 AS h
            FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100, bytes
        ), rebuilt AS (
            SELECT conv_id, list_concat(coalesce(others[1:h], []), turns[h + 1:]) AS turns FROM heads
        ), prefixes AS (
            SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
        ), members AS (
            SELECT conv_id, size, depth, turns[1:depth] AS prefix FROM prefixes
        ), nodes AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN length(any_value(prefix)[depth].text) ELSE 0 END AS chars,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
            FROM members GROUP BY depth, prefix
        ), linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
        ), children AS (
            SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), counted AS (
            SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (depth, prefix)
        ), below AS (
            SELECT a.depth AS depth, a.prefix AS prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
            FROM counted a JOIN (SELECT *, unnest(range(depth + 1)) AS up FROM counted) b ON a.depth = b.up AND a.prefix = b.prefix[1:b.up]
            GROUP BY ALL
        )
        SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, c.ends_sha256
        FROM counted c JOIN below b USING (depth, prefix)
    """,
}
