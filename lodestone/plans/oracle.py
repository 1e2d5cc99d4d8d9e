"""DuckDB SQL that must give the same rows as the queries of ``catalog``."""

from __future__ import annotations

from lodestone.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


_BM25 = f"""
    listed AS (SELECT doc_id AS doc, {_tokens("text")} AS terms FROM documents),
    lengths AS (SELECT doc, len(terms) AS length FROM listed),
    postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM listed) GROUP BY doc, term),
    freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(length) AS DOUBLE) / count(*) AS avg_dl FROM lengths)"""


def _scores(distinct: bool = True) -> str:
    return f"""{_BM25},
    asked AS (SELECT {"DISTINCT" if distinct else ""} query, term FROM (SELECT item_id AS query, unnest({_tokens("text")}) AS term FROM benchmark)),
    scores AS (
        SELECT query, doc, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_dl)))), 6) AS score
        FROM asked JOIN freq USING (term) JOIN postings USING (term) JOIN lengths USING (doc), stats GROUP BY query, doc
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM scores),
    positives AS (SELECT query, doc FROM placed WHERE r <= 2)"""


def _negatives(allowed: str = "TRUE") -> str:
    return f"""negatives AS (
        SELECT * FROM (SELECT p.query, p.doc, p.score, row_number() OVER (PARTITION BY p.query ORDER BY p.score DESC, p.doc) AS rank
            FROM placed p ANTI JOIN positives x ON p.query = x.query AND p.doc = x.doc
            WHERE p.r <= 66 + (SELECT count(*) FROM positives y WHERE y.query = p.query) AND {allowed}) WHERE rank <= 16
    )"""


_GAPS = f"""{_scores()}, {_negatives()},
    gaps AS (
        SELECT q.query, coalesce(round(b.pos - n.score, 6), 0.0::DOUBLE) AS gap FROM (SELECT DISTINCT query FROM positives) q
        LEFT JOIN (SELECT query, max(score) AS pos FROM scores SEMI JOIN positives USING (query, doc) GROUP BY query) b USING (query)
        LEFT JOIN (SELECT query, score FROM negatives WHERE rank = 1) n USING (query)
    )"""


def _int(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


_DOT = "list_inner_product(list_transform({}, lambda x: x::DOUBLE), list_transform({}, lambda x: x::DOUBLE))"


def _knn(where_q: str, where_v: str, k: int) -> str:
    return f"""
        SELECT query, CAST(rank AS INTEGER) AS rank, id, score FROM (
            SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
                SELECT q.vec_id AS query, v.vec_id AS id, round({_DOT.format("q.embedding", "v.embedding")}, 6) AS score
                FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE {where_q} AND {where_v}
            )
        ) WHERE rank <= {k}"""


_EDGES = """edges AS (
        SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'PLACED_BY' AS edge_type FROM orders
        UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, 'PART_OF' FROM lineitem
        UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 'p' || l_partkey, 'USES' FROM lineitem
        UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 's' || l_suppkey, 'SUPPLIED_BY' FROM lineitem
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN' FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SITS_IN' FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION' FROM nation
    )"""


def _bfs(hops: int, types: str = "TRUE") -> str:
    """Written out hop by hop."""
    parts = [f"""{_EDGES}, both_ways AS (SELECT src, dst FROM edges WHERE {types} UNION ALL SELECT dst, src FROM edges WHERE {types}),
        h0 AS (SELECT 'o1' AS id, 0 AS hop UNION ALL SELECT 'c5', 0)"""]
    for h in range(1, hops + 1):
        parts.append(f"h{h} AS (SELECT id, min(hop) AS hop FROM (SELECT * FROM h{h - 1} UNION ALL SELECT b.dst, {h} FROM both_ways b JOIN h{h - 1} ON b.src = h{h - 1}.id) GROUP BY id)")
    return "WITH " + ", ".join(parts)


_PAGES = "pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS file_path FROM pages)"

_LONGEST = f"list_sort(list_transform({_tokens('text')}, lambda t: {{'l': -length(t), 't': t}}))[1].t"
_GOLD = f"""gold AS (
        SELECT DISTINCT f.query, h.doc FROM (SELECT item_id AS query, {_LONGEST} AS term FROM benchmark) f
        JOIN (SELECT doc_id AS doc, unnest({_tokens("text")}) AS term FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) h USING (term)
    )"""


def _metrics(results: str) -> str:
    return f"""
        SELECT query,
            CASE WHEN hits > 0 THEN round(dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6) ELSE 0.0 END AS ndcg_retrieved,
            round(dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6) AS ndcg,
            round(CAST(hits AS DOUBLE) / greatest(n_rel, 1), 6) AS recall, coalesce(round(1.0::DOUBLE / first, 6), 0.0::DOUBLE) AS mrr
        FROM (
            SELECT c.query, c.n_rel, coalesce(sum(CASE WHEN g.doc IS NOT NULL THEN 1.0::DOUBLE / log2(r.rank + 1.0::DOUBLE) END), 0.0::DOUBLE) AS dcg,
                CAST(count(g.doc) AS BIGINT) AS hits, min(CASE WHEN g.doc IS NOT NULL THEN r.rank END) AS first
            FROM (SELECT query, count(*) AS n_rel FROM gold GROUP BY query) c
            LEFT JOIN {results} r ON r.query = c.query LEFT JOIN gold g ON g.query = r.query AND g.doc = r.doc GROUP BY c.query, c.n_rel
        )"""


def _rerank(weights: str, default: str, source: str, k: int) -> str:
    return f"""
        SELECT query, rank, id, score FROM (
            SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
                SELECT s.query, s.doc AS id, round(s.score * CASE d.lang {weights} ELSE {default}::DOUBLE END * (1.0::DOUBLE + 0.1::DOUBLE * least(1.0::DOUBLE, d.n_chars / 200.0::DOUBLE)), 6) AS score
                FROM {source} s JOIN documents d ON d.doc_id = s.doc
            )
        ) WHERE rank <= {k}"""


_SIMILAR = f"""sim AS (
        SELECT q.vec_id AS query, round({_DOT.format("q.embedding", "c.embedding")}, 6) AS score, c.vec_id = q.vec_id + 1 AS is_positive
        FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    )"""

ORACLE: dict[str, str] = {
    "bm25_term_stats": f"WITH {_BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term",
    "bm25_corpus_stats": f"WITH {_BM25} SELECT CAST(n AS BIGINT) AS n, round(avg_dl, 6) AS avg_dl FROM stats",
    "bm25_topk": f"WITH {_scores()} SELECT query, CAST(r AS INTEGER) AS rank, doc, score FROM placed WHERE r <= 10",
    "bm25_score_pairs": f"WITH {_scores(False)} SELECT query, doc, score FROM scores",
    "hard_negatives": f"WITH {_scores()}, {_negatives()} SELECT query, CAST(rank AS INTEGER) AS rank, doc, score FROM negatives",
    "hard_negatives_prefix": f"""WITH {_scores()}, best AS (SELECT p.query, d.source FROM placed p JOIN documents d ON d.doc_id = p.doc WHERE p.r = 1),
        {_negatives("(SELECT d.source FROM documents d WHERE d.doc_id = p.doc) = (SELECT b.source FROM best b WHERE b.query = p.query)")}
        SELECT query, CAST(rank AS INTEGER) AS rank, doc, score FROM negatives""",
    "difficulty_gap": f"WITH {_GAPS} SELECT query, gap FROM gaps",
    "difficulty_rank": f"WITH {_GAPS} SELECT query, gap, round(1.0::DOUBLE - (rank() OVER (ORDER BY gap) - 1) / CAST(greatest(count(*) OVER () - 1, 1) AS DOUBLE), 6) AS difficulty FROM gaps",
    "gap_summary": f"WITH {_GAPS} SELECT min(gap) AS low, round(quantile_cont(gap, 0.5), 6) AS mid, max(gap) AS high FROM gaps",
    "knn_exact": _knn("q.vec_id % 50 = 0", "TRUE", 10),
    "knn_filtered": _knn("q.vec_id % 50 = 0", "v.label = 3", 10),
    "cosine_pairs": f"""SELECT a.vec_id AS id, round({_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})), 6) AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "centroid_pool": """WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(list_transform(embedding, lambda e: e::DOUBLE)) AS x FROM embeddings) GROUP BY label, pos)
        SELECT label, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "edges_by_type": f"WITH {_EDGES} SELECT src, dst, edge_type FROM edges WHERE edge_type <> 'NONE'",
    "edge_counts": f"WITH {_EDGES} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type",
    "degree": f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id",
    "hub_topk": f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 20",
    "bfs_1hop": f"{_bfs(1)} SELECT id, CAST(hop AS INTEGER) AS hop FROM h1",
    "bfs_2hop": f"{_bfs(2)} SELECT id, CAST(hop AS INTEGER) AS hop FROM h2",
    "bfs_typed": f"""{_bfs(2, "edge_type IN ('PLACED_BY', 'PART_OF')")} SELECT id, CAST(hop AS INTEGER) AS hop FROM h2""",
    "bfs_capped": f"{_bfs(2)} SELECT id, CAST(hop AS INTEGER) AS hop FROM h2 ORDER BY hop, id LIMIT 25",
    "induced_subgraph": f"{_bfs(2).replace('edges AS (', 'edges AS MATERIALIZED (', 1).replace('both_ways AS (', 'both_ways AS MATERIALIZED (').replace('h1 AS (', 'h1 AS MATERIALIZED (').replace('h2 AS (', 'h2 AS MATERIALIZED (')} SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM h2) AND dst IN (SELECT id FROM h2)",
    "two_hop_path": f"WITH {_EDGES} SELECT a.src, a.dst AS via, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.edge_type = 'PLACED_BY' AND b.edge_type = 'LIVES_IN'",
    "callers_of": "SELECT 'o' || o_orderkey AS id, o_orderpriority AS symbol_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)",
    "callees_of": "SELECT 'c' || c_custkey AS id, n_name AS symbol_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '2-HIGH'",
    "reference_edges": f"""WITH n AS (SELECT 'd' || doc_id AS id, {_tokens("text")} AS t FROM documents), r AS (SELECT id, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), lambda x: x IS NOT NULL)[1:3] AS refs FROM n)
        SELECT src, count(*) AS n, min(dst) AS first, max(dst) AS last FROM (SELECT a.id AS src, b.id AS dst FROM (SELECT id, unnest(refs) AS s FROM r) a JOIN (SELECT id, t[1] AS s FROM n) b ON a.s = b.s AND a.id <> b.id) GROUP BY src""",
    "suffix_join": f"""WITH {_PAGES}, refs AS (SELECT page_id AS src, string_split(file_path, '/')[-1] AS ref FROM pg)
        SELECT r.src, r.ref, min(p.page_id) AS dst FROM refs r JOIN pg p ON p.page_id <> r.src AND (p.file_path = r.ref OR ends_with(p.file_path, '/' || r.ref)) GROUP BY r.src, r.ref""",
    "path_subsystem_counts": f"WITH {_PAGES} SELECT string_split(file_path, '/')[1] AS subsystem, count(*) AS n FROM pg GROUP BY 1",
    "asof_event": """SELECT event_id, click_id FROM (
            SELECT p.event_id, c.event_id AS click_id, row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC, c.event_id DESC) AS r
            FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts WHERE p.event_type = 'purchase' AND c.event_type = 'click'
        ) WHERE r = 1""",
    "asof_contained": """SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(v.ts) < 60000000 THEN v.view_id END AS view_id
        FROM (SELECT event_id, ts FROM events WHERE event_type = 'error') e
        ASOF LEFT JOIN (SELECT ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ts) v ON e.ts >= v.ts""",
    "nearest_distinct": """SELECT c.event_id, v.name FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS a FROM events WHERE event_type = 'click') c
        ASOF LEFT JOIN (SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS a, CAST(min(event_id) AS VARCHAR) AS name FROM events WHERE event_type = 'view' GROUP BY 1) v ON c.a >= v.a""",
    "range_join_first": """WITH o AS (SELECT o_orderkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d FROM orders),
        r AS (SELECT k, 0 AS nth, d AS a, d + 40 AS b FROM o UNION ALL SELECT k, 1, d + 20, d + 400 FROM o),
        p AS (SELECT l_orderkey AS k, l_linenumber AS line, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS d FROM lineitem)
        SELECT p.k, p.line, CAST(p.d AS BIGINT) AS day, CAST(min(nth) AS INTEGER) AS nth FROM p JOIN r ON p.k = r.k AND p.d BETWEEN r.a AND r.b GROUP BY p.k, p.line, p.d""",
    "interval_overlap": """WITH o AS (SELECT o_custkey, o_orderkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a FROM orders)
        SELECT x.o_custkey, x.k AS first_key, y.k AS second_key FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.k < y.k AND x.a <= y.a + 30 AND y.a <= x.a + 30""",
    "upper_median": "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS upper_median FROM events GROUP BY event_type",
    "slide": """WITH u AS (SELECT user_id, CAST(max(floor(epoch_us(ts) / 1000000)) - min(floor(epoch_us(ts) / 1000000)) AS BIGINT) AS s FROM events WHERE user_id BETWEEN 1 AND 8 GROUP BY user_id)
        SELECT list_sort(list(s))[count(*) // 2 + 1] AS slide FROM u""",
    "link_verified": """SELECT CAST(s_nationkey AS VARCHAR) AS name, s_suppkey AS addr_start, s_suppkey + 5 AS live_addr, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey + 5) AS verified FROM supplier""",
    "hybrid_search": f"""WITH e AS MATERIALIZED (SELECT query AS src, id AS dst FROM ({_knn("TRUE", "TRUE", 5)})),
        p AS MATERIALIZED (SELECT query, id FROM ({_knn("q.vec_id % 50 = 0", "TRUE", 8)})), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        h0 AS (SELECT query, id, 0 AS hop FROM p), h1 AS MATERIALIZED (SELECT query, id, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT query, b.dst, 1 FROM b JOIN h0 ON b.src = h0.id) GROUP BY query, id),
        h2 AS (SELECT query, id, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT query, b.dst, 2 FROM b JOIN h1 ON b.src = h1.id) GROUP BY query, id),
        cap AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hop, id) AS r FROM h2)
        SELECT query, id, 'primary' AS role, 0 AS hop FROM p UNION ALL SELECT query, id, 'context', CAST(hop AS INTEGER) FROM cap ANTI JOIN p USING (query, id) WHERE r <= 30""",
    "rule_rerank": f"""WITH {_scores()}, top AS (SELECT * FROM placed WHERE r <= 20)
        SELECT query, CAST(rank AS INTEGER) AS rank, id, score FROM ({_rerank("WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 0.9::DOUBLE WHEN 'fr' THEN 0.8::DOUBLE WHEN 'es' THEN 0.5::DOUBLE", "0.7", "top", 10)})""",
    "ranking_metrics": f"WITH {_scores()}, {_GOLD} {_metrics('(SELECT query, doc, r AS rank FROM placed WHERE r <= 10)')}",
    "arms_avg": f"""WITH {_scores()}, {_GOLD}, top AS (SELECT * FROM placed WHERE r <= 10),
        ruled AS (SELECT query, id AS doc, rank FROM ({_rerank("WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 1.0::DOUBLE", "0.9", "top", 10)})),
        m AS (SELECT 'keyword' AS arm, * FROM ({_metrics("(SELECT query, doc, r AS rank FROM top)")}) UNION ALL SELECT 'rule', * FROM ({_metrics("ruled")}))
        SELECT arm, round(avg(ndcg_retrieved), 6) AS ndcg_retrieved, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM m GROUP BY arm""",
    "infonce": f"WITH {_SIMILAR}, t AS (SELECT query, score / 0.1::DOUBLE AS t, is_positive, max(score / 0.1::DOUBLE) OVER (PARTITION BY query) AS top FROM sim) SELECT query, round(ln(sum(exp(t - top))) - max(CASE WHEN is_positive THEN t - top END), 6) AS loss FROM t GROUP BY query",
    "infonce_slices": f"""WITH s AS (SELECT q.vec_id AS query, round({_DOT.format("q.embedding", "v.embedding")}, 6) AS score, v.vec_id = q.vec_id + 1 AS is_positive FROM embeddings q JOIN embeddings v ON q.vec_id // 100 = v.vec_id // 100 AND q.vec_id <> v.vec_id WHERE q.vec_id % 10 = 0),
        t AS (SELECT query, score / 0.1::DOUBLE AS t, is_positive, max(score / 0.1::DOUBLE) OVER (PARTITION BY query) AS top FROM s)
        SELECT query, round(ln(sum(exp(t - top))) - max(CASE WHEN is_positive THEN t - top END), 6) AS loss FROM t GROUP BY query""",
    "margin_loss": f"WITH {_SIMILAR} SELECT round(avg(greatest(0.0::DOUBLE, 1.0::DOUBLE - p.score + n.score)), 6) AS loss FROM sim p JOIN sim n ON p.query = n.query AND p.is_positive AND NOT n.is_positive",
    "reranker_metrics": f"WITH {_SIMILAR}, r AS (SELECT p.query, count(CASE WHEN n.score >= p.score THEN 1 END) + 1 AS rank FROM sim p LEFT JOIN sim n ON p.query = n.query AND NOT n.is_positive WHERE p.is_positive GROUP BY p.query) SELECT query, rank, round(1.0::DOUBLE / log2(rank + 1.0::DOUBLE), 6) AS ndcg FROM r",
    "mean_deviation": "SELECT round(avg(value), 6) AS mean, coalesce(round(stddev_samp(value), 6), 0.0::DOUBLE) AS deviation FROM events",
    "time_split": """SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 'val' ELSE 'test' END AS part, count(*) AS n, min(o_orderdate) AS first FROM orders GROUP BY 1""",
    "curriculum_ratio": """SELECT doc_id, CAST(e AS INTEGER) AS epoch, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.8::DOUBLE * (e / 3.0::DOUBLE + (1.0::DOUBLE - e / 3.0::DOUBLE) * (1.0::DOUBLE - (doc_id % 11) / 10.0::DOUBLE)))), 6) AS ratio
        FROM documents, (SELECT unnest(range(0, 4)) AS e)""",
    "synth_symbol": "SELECT 'how does ' || p_name || ' work' AS query, p_partkey AS positive, 0.5::DOUBLE AS difficulty FROM part",
    "synth_sentence": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '(?m)^\s*\*+\s?', ' ', 'g'), '/\*+|\*+/', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM documents WHERE trim(text) <> ''),
        t AS (SELECT doc_id, CASE WHEN regexp_extract(flat, '^(.*?\.)\s', 1) <> '' THEN regexp_extract(flat, '^(.*?\.)\s', 1) ELSE flat END AS s FROM f)
        SELECT s AS query, doc_id AS positive FROM t WHERE length(s) BETWEEN 15 AND 300 AND length(s) - length(replace(replace(s, '{', ''), ';', '')) <= 3""",
    "synth_topk_len": "SELECT doc_id, source, n_chars, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, n_chars, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE n >= 3 AND rank <= 5",
    "easy_negatives_hash": """WITH pool AS (SELECT doc_id AS id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents),
        g AS (SELECT source, min(pos) AS start, count(*) AS size, any_value(total) - count(*) AS rest FROM pool GROUP BY source),
        q AS (SELECT d.doc_id AS query, start, size, rest, least(rest, 8) AS picks, unnest(range(1, least(rest, 8) + 1)) AS pick FROM documents d JOIN g ON g.source = d.source),
        r AS (SELECT query, pick, start, size, rest * (pick - 1) // picks AS low, rest * pick // picks AS high FROM q),
        x AS (SELECT query, pick, start, size, low + CAST('0x' || substr(md5('42:' || query || ':' || pick), 1, 12) AS BIGINT) % (high - low) AS pos FROM r)
        SELECT query, id, CAST(pick AS INTEGER) AS pick FROM x JOIN pool p ON p.pos = CASE WHEN x.pos >= start THEN x.pos + size ELSE x.pos END""",
    "dedup_last_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "ordered_distinct": "WITH w AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS p FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)), f AS (SELECT doc_id, x, min(p) AS p FROM w GROUP BY ALL) SELECT doc_id, md5(string_agg(x, ' ' ORDER BY p)) AS words, count(*) AS n FROM f GROUP BY doc_id",
    "regex_rules_first_match": r"""SELECT page_id, CASE WHEN regexp_full_match(url, 'https://[^/]*\.example\.org/.*') THEN 'secure-org' WHEN regexp_full_match(url, 'https?://[^/]*\.example\.(com|net)/de/.*') THEN 'german'
        WHEN regexp_full_match(url, '.*\?page=\d+.*') THEN 'paged' WHEN regexp_full_match(url, 'http://.*') THEN 'plain' END AS rule FROM pages""",
    "tree_hash": "SELECT source AS snapshot_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS tree_hash FROM (SELECT source, 'doc/' || doc_id || ' ' || sha256(text) AS line FROM documents) GROUP BY source",
    "state_latest": "SELECT user_id AS id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "context_budget": f"""WITH {_scores()}, s AS (SELECT p.query, p.r AS rank, p.doc, CAST(sum(d.n_chars) OVER (PARTITION BY p.query ORDER BY p.r) AS BIGINT) AS running FROM placed p JOIN documents d ON d.doc_id = p.doc WHERE p.r <= 10)
        SELECT query, CAST(rank AS INTEGER) AS rank, doc, running FROM s WHERE running <= 8192 OR rank = 1""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type",
    "set_operations": """WITH b AS (SELECT DISTINCT user_id, day(ts) AS day FROM events WHERE event_type = 'purchase'), f AS (SELECT DISTINCT user_id, day(ts) AS day FROM events WHERE event_type = 'error'),
        k AS (SELECT user_id, day, 'both' AS kind FROM (SELECT * FROM b INTERSECT SELECT * FROM f) UNION ALL SELECT user_id, day, 'bought' FROM (SELECT * FROM b EXCEPT SELECT * FROM f))
        SELECT CAST(day AS INTEGER) AS day, kind, count(*) AS n FROM k GROUP BY day, kind""",
}
