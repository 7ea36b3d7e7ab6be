"""Oracle SQL of the knowledge and retrieval layers."""

from __future__ import annotations

import numpy as np

from oracle.base import CTE, RECURSIVE, compose

SQL: dict[str, str] = {}
NL = "chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CTE["x_docs"] = "SELECT *, source || '/' || doc_id AS stem FROM documents"
CTE["x_lines"] = f"""SELECT doc_id, stem, text, md5(text)[1:8] AS mark, len(string_split(text, {NL})) AS n_lines,
    unnest(string_split(text, {NL})) AS line, unnest(range(len(string_split(text, {NL})))) AS i FROM x_docs"""
CTE["x_md"] = f"""SELECT doc_id, stem, any_value(text) AS plain, string_agg(
      CASE WHEN (i + n_lines) % 7 = 0
           THEN repeat('#', CAST((i // 7 + n_lines) % 4 + 1 AS INT)) || ' Part ' || mark || '-' || i || {NL} ELSE '' END
      || line || CASE WHEN i % 3 = 2 THEN {NL} ELSE '' END, {NL} ORDER BY i) AS text
    FROM x_lines GROUP BY doc_id, stem"""
CTE["k_docs"] = """SELECT d.doc_id, d.plain, d.text, sha256(d.text) AS document_id,
    CASE WHEN regexp_matches(d.text, '(?m)^#{1,6}\\s+.')
         THEN trim(regexp_extract(d.text, '(?m)^(#{1,6})\\s+(.+)$', 2)) ELSE d.stem END AS title
    FROM x_md d WHERE d.doc_id IN (SELECT max(doc_id) FROM x_md GROUP BY sha256(text))"""

# Sections by a running count of heading lines; the path from depths: depth = k + min(0, min(level - index)).
CTE["k_lines"] = f"""SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.') AS is_heading FROM (
    SELECT document_id, title, unnest(string_split(text, {NL})) AS line,
      unnest(range(len(string_split(text, {NL})))) AS i FROM k_docs)"""
CTE["k_numbered"] = """SELECT *, CAST(count(*) FILTER (WHERE is_heading)
    OVER (PARTITION BY document_id ORDER BY i) AS INT) AS section FROM k_lines"""
CTE["k_heads"] = """SELECT document_id, section, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level,
    trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) AS heading FROM k_numbered WHERE is_heading"""
CTE["k_depths"] = """SELECT *, section + least(0, min(level - section)
    OVER (PARTITION BY document_id ORDER BY section)) AS depth FROM k_heads"""
_LAST = ", ".join(
    f"last_value(CASE WHEN depth = {p} THEN heading END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY section) AS p{p}"
    for p in range(1, 7)
)
CTE["k_places"] = f"SELECT document_id, section, depth, {_LAST} FROM k_depths"
CTE["k_paths"] = "SELECT document_id, section, concat_ws(' > ', " + ", ".join(
    f"CASE WHEN depth >= {p} THEN p{p} END" for p in range(1, 7)
) + ") AS heading_path, concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN depth >= {p} THEN p{p} END" for p in range(1, 7)
) + ") AS path_lines FROM k_places"
CTE["k_bodies"] = f"""SELECT document_id, title, section, trim(string_agg(line, {NL} ORDER BY i), {WS}) AS body
    FROM k_numbered WHERE NOT is_heading GROUP BY document_id, title, section"""


def _packed(source: str, key: str, body: str, sep: str, name: str) -> None:
    """Greedy packing, one paragraph per recursion step."""
    step = f"trim(r.buffer || {sep} || r.parts[r.i + 1], {WS})"
    full = f"(r.buffer <> '' AND length({step}) > 600)"
    CTE[name] = f"""SELECT {key}, string_split({body}, {sep}) AS parts, 0 AS i, '' AS buffer,
          CAST(NULL AS VARCHAR) AS done FROM {source} WHERE {body} <> ''
        UNION ALL
        SELECT {', '.join('r.' + c.strip() for c in key.split(','))}, r.parts, r.i + 1,
          CASE WHEN {full} THEN r.parts[r.i + 1] ELSE {step} END, CASE WHEN {full} THEN r.buffer END
        FROM {name} r WHERE r.i < len(r.parts)"""
    RECURSIVE.add(name)


_packed("k_bodies", "document_id, title, section", "body", f"{NL} || {NL}", "k_packing")
CTE["k_pieces"] = """SELECT document_id, title, section, i, done AS content FROM k_packing WHERE done IS NOT NULL
    UNION ALL SELECT document_id, title, section, i + 1, buffer FROM k_packing WHERE i = len(parts) AND buffer <> ''"""
CTE["k_ordinals"] = """SELECT p.*, CAST(row_number() OVER (PARTITION BY p.document_id ORDER BY p.section, p.i) - 1 AS INT) AS ordinal,
    coalesce(h.heading_path, '') AS heading_path, coalesce(h.path_lines, '') AS path_lines
    FROM k_pieces p LEFT JOIN k_paths h ON p.document_id = h.document_id AND p.section = h.section"""
CTE["k_chunks"] = """SELECT sha256(document_id || ':' || ordinal || ':' || content) AS chunk_id, *,
    CAST(greatest(1, length(content) // 3) AS INT) AS token_count FROM k_ordinals"""

SQL["content_hash"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"
SQL["doc_title"] = """SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^#{1,6}\\s+.')
    THEN trim(regexp_extract(text, '(?m)^(#{1,6})\\s+(.+)$', 2)) ELSE stem END AS title FROM x_md"""
SQL["dedup_documents"] = """SELECT doc_id, sha256(text) AS content_hash, stem FROM x_docs
    WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY text)"""
SQL["heading_path"] = "SELECT document_id, ordinal, heading_path FROM k_chunks"
SQL["chunk_identity"] = "SELECT chunk_id, document_id, ordinal, token_count FROM k_chunks"
SQL["chunk_documents"] = """SELECT chunk_id, document_id, title, ordinal, heading_path, content, token_count
    FROM k_chunks"""

CTE["l_docs"] = f"""SELECT sha256(text) AS document_id, stem AS title, trim(text, {WS}) AS body FROM x_docs
    WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY text)"""
_packed("l_docs", "document_id, title", "body", NL, "l_packing")
CTE["l_pieces"] = """SELECT document_id, title, i, done AS content FROM l_packing WHERE done IS NOT NULL
    UNION ALL SELECT document_id, title, i + 1, buffer FROM l_packing WHERE i = len(parts) AND buffer <> ''"""
CTE["l_chunks"] = """SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INT) AS ordinal
    FROM l_pieces"""
SQL["chunk_documents_by_line"] = """SELECT sha256(document_id || ':' || ordinal || ':' || content) AS chunk_id, document_id,
    title, ordinal, '' AS heading_path, content, CAST(greatest(1, length(content) // 3) AS INT) AS token_count
    FROM l_chunks"""

# Tokens: the test texts hold no Chinese, and NFKC changes no Latin word of them.
WORDS = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_-]+')"
SQL["tokenize"] = f"""SELECT doc_id, len({WORDS.format('text')}) AS tokens,
    md5(array_to_string({WORDS.format('text')}, ' ')) AS token_hash FROM documents"""


def _embedding(prefix: str, source: str, key: str, text: str) -> None:
    """Sparse hashed embeddings: <prefix>_vec (key, bucket, value) with md5 as digest and 384 buckets."""
    byte = "CAST(('0x' || h[{}:{}]) AS INT)"
    tail = " + ".join(byte.format(2 * b + 1, 2 * b + 2) for b in range(1, 8))
    CTE[f"{prefix}_tok"] = f"""SELECT {key}, token, count(*) AS n FROM (
        SELECT {key}, unnest({WORDS.format(text)}) AS token FROM {source}) GROUP BY {key}, token"""
    CTE[f"{prefix}_hash"] = f"SELECT *, md5(token) AS h FROM {prefix}_tok"
    CTE[f"{prefix}_sum"] = f"""SELECT {key}, ({byte.format(1, 2)} + 256 * ({tail})) % 384 AS bucket,
        sum((CASE WHEN {byte.format(17, 18)} % 2 = 1 THEN 1.0 ELSE -1.0 END)
            * (1.0 + ln(1.0 + CAST(n AS DOUBLE)))) AS v
        FROM {prefix}_hash GROUP BY 1, 2"""
    CTE[f"{prefix}_vec"] = f"""SELECT s.{key}, s.bucket,
        CAST(CAST(round(s.v / t.norm, 8) AS FLOAT) AS DOUBLE) AS value
        FROM {prefix}_sum s JOIN (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {prefix}_sum GROUP BY 1) t
        ON s.{key} = t.{key} WHERE t.norm > 0"""


_embedding("d", "documents", "doc_id", "text")
SQL["hash_embedding"] = """SELECT d.doc_id, coalesce(round(sum(value * value), 4), 0) AS norm,
    coalesce(round(sum(value * (bucket + 1)), 4), 0) AS checksum,
    CAST(count(value) FILTER (WHERE value <> 0) AS INT) AS filled
    FROM documents d LEFT JOIN d_vec v ON d.doc_id = v.doc_id GROUP BY 1"""
CTE["k_texts"] = """SELECT *, concat_ws(chr(10), title, CASE WHEN path_lines <> '' THEN path_lines END, content) AS full_text
    FROM k_chunks"""
SQL["embedding_text"] = "SELECT chunk_id, md5(full_text) AS text_hash FROM k_texts"
SQL["ingest_knowledge"] = "SELECT chunk_id, document_id, ordinal, TRUE AS embedded FROM k_chunks"
SQL["knowledge_status"] = """SELECT count(*) AS chunk_count, count(*) AS embedded_chunk_count,
    count(DISTINCT document_id) AS document_count, 1.0::DOUBLE AS embedding_coverage FROM k_chunks"""
SQL["document_status_counts"] = "SELECT 'ready' AS status, count(*) AS document_count FROM k_docs"
SQL["list_documents"] = """SELECT d.document_id, d.title, 'ready' AS status, count(c.chunk_id) AS chunk_count,
    count(c.chunk_id) AS embedded_chunk_count FROM k_docs d LEFT JOIN k_chunks c ON d.document_id = c.document_id
    GROUP BY 1, 2"""

# --- queries ---------------------------------------------------------------------------------------
_GROUPS = {
    "late": "延期 延迟 配送 送达 delivery late", "packaging": "包装 发货 破损 检查 packaging",
    "review": "差评 低分 评论 客户 review", "seller": "卖家 绩效 复盘 seller", "freight": "运费 成本 物流 freight",
    "payment": "支付 付款 信用卡 分期 payment", "evidence": "证据 引用 报告 口径 evidence",
    "security": "安全 审批 权限 越权 security",
}
_ADDED = " || ".join(
    f"CASE WHEN contains(lower(query), '{w}') THEN string_split('{a}', ' ') ELSE CAST([] AS VARCHAR[]) END"
    for w, a in _GROUPS.items()
)
CTE["q_all"] = f"""SELECT item_id AS query_id, trim(text, {WS}) AS query FROM benchmark
    WHERE trim(text, {WS}) <> ''"""
CTE["q_raw"] = f"SELECT query_id, {_ADDED} || {WORDS.format('query')} AS words FROM q_all"
CTE["q_first"] = """SELECT query_id, term, min(pos) AS pos FROM (
      SELECT query_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM q_raw)
    WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1, 2"""
CTE["q_terms"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM q_first)
    WHERE n <= 18"""
SQL["expand_query"] = "SELECT query_id, string_agg(term, ' ' ORDER BY n) AS terms FROM q_terms GROUP BY 1"

# --- candidates ------------------------------------------------------------------------------------
CTE["c_words"] = """SELECT chunk_id, word, count(*) AS n FROM (
    SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS word FROM k_chunks) GROUP BY 1, 2"""
CTE["c_fts"] = """SELECT query_id, chunk_id, sum(c_words.n) AS words FROM q_terms JOIN c_words ON term = word
    WHERE regexp_full_match(term, '[\\p{L}\\p{N}]+') GROUP BY 1, 2"""
CTE["c_hits"] = """SELECT query_id, chunk_id, title, ordinal, count(*) AS lexical_hits,
    count(*) FILTER (WHERE title ILIKE '%' || term || '%') AS title_hits
    FROM q_terms, k_chunks WHERE content ILIKE '%' || term || '%' OR title ILIKE '%' || term || '%'
    GROUP BY 1, 2, 3, 4"""
CTE["c_lexical"] = """SELECT h.query_id, h.chunk_id, CAST(title_hits AS INT) AS title_hits,
    CAST(lexical_hits AS INT) AS lexical_hits, round(coalesce(words, 0) * 0.1::DOUBLE, 8) AS fts_score,
    CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY title_hits DESC, lexical_hits DESC,
      coalesce(words, 0) DESC, title, ordinal, h.chunk_id) AS INT) AS fts_rank
    FROM c_hits h LEFT JOIN c_fts f ON h.query_id = f.query_id AND h.chunk_id = f.chunk_id"""
CTE["top_lexical"] = "SELECT * FROM c_lexical WHERE fts_rank <= 30"
SQL["lexical_candidates"] = """SELECT query_id, chunk_id, fts_rank, title_hits, lexical_hits, fts_score FROM top_lexical"""

SQL["fts_score"] = "SELECT query_id, chunk_id, round(words * 0.1::DOUBLE, 8) AS fts_score FROM c_fts"

_embedding("c", "k_texts", "chunk_id", "full_text")
_embedding("q", "q_all", "query_id", "query")
CTE["c_norms"] = "SELECT chunk_id, sqrt(sum(value * value)) AS norm FROM c_vec GROUP BY 1"
CTE["q_norms"] = "SELECT query_id, sqrt(sum(value * value)) AS norm FROM q_vec GROUP BY 1"
CTE["c_dots"] = """SELECT query_id, chunk_id, sum(q.value * c.value) AS dot FROM q_vec q JOIN c_vec c
    ON q.bucket = c.bucket GROUP BY 1, 2"""
CTE["c_scores"] = """SELECT q.query_id, k.chunk_id, CASE WHEN c.norm IS NOT NULL
      THEN round(coalesce(d.dot, 0) / (q.norm * c.norm), 8) END AS vector_score
    FROM q_norms q CROSS JOIN k_chunks k LEFT JOIN c_norms c ON k.chunk_id = c.chunk_id
    LEFT JOIN c_dots d ON d.query_id = q.query_id AND d.chunk_id = k.chunk_id"""
CTE["top_vector"] = """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY vector_score DESC NULLS LAST, chunk_id) AS INT) AS vector_rank FROM c_scores) WHERE vector_rank <= 30"""
SQL["vector_candidates"] = "SELECT query_id, chunk_id, vector_rank, vector_score FROM top_vector"

CTE["e_centroids"] = """SELECT label, pos, sum(CAST(value AS DOUBLE)) / count(*) AS mean FROM (
    SELECT label, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2"""
CTE["e_lists"] = "SELECT label, list(mean ORDER BY pos) AS centroid FROM e_centroids GROUP BY 1"
_COSINE = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 8)"
SQL["vector_candidates_centroids"] = f"""SELECT query_id, vec_id, vector_rank, vector_score FROM (
    SELECT l.label AS query_id, vec_id, {_COSINE} AS vector_score, CAST(row_number() OVER (PARTITION BY l.label
      ORDER BY {_COSINE} DESC, vec_id) AS INT) AS vector_rank FROM embeddings, e_lists l) WHERE vector_rank <= 30"""
SQL["vector_candidates_lsh_all_codes"] = SQL["vector_candidates_centroids"]


def _sign_code(vector: str) -> str:
    """Sign code by the index's planes, which a fixed seed gives as literal numbers."""
    planes = np.random.default_rng(7).standard_normal((64, 6))
    return " + ".join(
        f"CASE WHEN list_dot_product(CAST({vector} AS DOUBLE[]), [{', '.join(repr(float(x)) for x in planes[:, b])}]) > 0 THEN {1 << b} ELSE 0 END"
        for b in range(6))


CTE["e_codes"] = f"SELECT vec_id, embedding, {_sign_code('embedding')} AS code FROM embeddings"
CTE["l_codes"] = f"SELECT label, centroid, {_sign_code('centroid')} AS code FROM e_lists"
SQL["vector_candidates_lsh"] = f"""SELECT query_id, vec_id, vector_rank, vector_score FROM (
    SELECT l.label AS query_id, vec_id, {_COSINE} AS vector_score, CAST(row_number() OVER (PARTITION BY l.label
      ORDER BY {_COSINE} DESC, vec_id) AS INT) AS vector_rank FROM e_codes e, l_codes l
    WHERE bit_count(xor(e.code, l.code)) <= 2) WHERE vector_rank <= 30"""
SQL["cosine_similarity"] = f"""SELECT vec_id, {_COSINE} AS similarity FROM embeddings e
    JOIN e_lists l ON e.label = l.label"""

# --- fusion ----------------------------------------------------------------------------------------
CTE["fused"] = """SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.chunk_id, v.chunk_id) AS chunk_id,
    fts_rank, vector_rank, coalesce(title_hits, 0) AS title_hits, coalesce(lexical_hits, 0) AS lexical_hits,
    coalesce(fts_score, 0) AS fts_score, vector_score,
    coalesce(0.75::DOUBLE / (60 + fts_rank), 0) + coalesce(0.25::DOUBLE / (60 + vector_rank), 0) AS raw_score
    FROM top_lexical l FULL JOIN top_vector v ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id"""
SQL["rrf_fuse"] = "SELECT query_id, chunk_id, fts_rank, vector_rank, round(raw_score, 8) AS rrf_score FROM fused"
CTE["fused_fts"] = """SELECT query_id, chunk_id, fts_rank, CAST(NULL AS INT) AS vector_rank, title_hits, lexical_hits,
    fts_score, CAST(NULL AS DOUBLE) AS vector_score, 1::DOUBLE / (60 + fts_rank) AS raw_score FROM top_lexical"""
CTE["fused_vector"] = """SELECT query_id, chunk_id, CAST(NULL AS INT) AS fts_rank, vector_rank,
    CAST(0 AS INT) AS title_hits, CAST(0 AS INT) AS lexical_hits, 0::DOUBLE AS fts_score, vector_score,
    1::DOUBLE / (60 + vector_rank) AS raw_score FROM top_vector"""
CTE["fused_bonus"] = """SELECT f.*, 0.0001::DOUBLE * least(5, coalesce(b.n, 0)) AS bonus FROM fused f LEFT JOIN (
    SELECT query_id, chunk_id, count(*) AS n FROM q_terms, k_chunks
    WHERE contains(lower(title), term) OR contains(lower(replace(path_lines, chr(10), ' ')), term) GROUP BY 1, 2) b
    ON f.query_id = b.query_id AND f.chunk_id = b.chunk_id"""
INJECTION = """(regexp_matches({0}, '(?i)ignore\\s+(all\\s+)?previous\\s+instructions')
    OR regexp_matches({0}, '忽略.{{0,8}}(之前|以上|系统).{{0,8}}(指令|规则)') OR regexp_matches({0}, '(?i)system\\s*prompt'))"""


def _best(name: str, source: str, final: str = "raw_score") -> None:
    CTE[f"best_{name}"] = f"""SELECT s.*, k.title, k.content FROM (
      SELECT *, round(raw_score, 8) AS rrf_score, round({final}, 8) AS rerank_score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({final}, 8) DESC, title_hits DESC,
          lexical_hits DESC, coalesce(vector_score, -1) DESC, fts_rank ASC NULLS LAST, vector_rank ASC NULLS LAST)
          AS INT) AS result_rank
      FROM {source}) s JOIN k_chunks k ON s.chunk_id = k.chunk_id WHERE result_rank <= 5"""
    SQL[f"hybrid_search{name}"] = f"""SELECT query_id, result_rank, chunk_id, title, fts_rank, vector_rank, title_hits,
      lexical_hits, fts_score, vector_score, rrf_score, rerank_score,
      {INJECTION.format('content')} AS potential_injection FROM best_{name}"""


_best("", "fused")
_best("_fts", "fused_fts")
_best("_vector", "fused_vector")
_best("_rerank", "fused_bonus", "raw_score + bonus")
SQL["search_excerpt"] = """SELECT query_id, result_rank, chunk_id,
    left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 800) AS excerpt FROM best_"""
SQL["search_log"] = """SELECT q.query_id, q.query, 'hybrid' AS retrieval_mode,
    coalesce((SELECT string_agg(term, ' ' ORDER BY n) FROM q_terms t WHERE t.query_id = q.query_id), '') AS expanded_terms,
    coalesce(l.n, 0) AS lexical_candidate_count, coalesce(v.n, 0) AS vector_candidate_count,
    coalesce(b.ids, '') AS result_chunk_ids, 0::DOUBLE AS duration_ms FROM q_all q
    LEFT JOIN (SELECT query_id, count(*) AS n FROM top_lexical GROUP BY 1) l ON l.query_id = q.query_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM top_vector GROUP BY 1) v ON v.query_id = q.query_id
    LEFT JOIN (SELECT query_id, string_agg(chunk_id, ' ' ORDER BY result_rank) AS ids FROM best_ GROUP BY 1) b
      ON b.query_id = q.query_id"""

SQL["write_search_log"] = SQL["search_log"]
CTE["q_gold"] = """SELECT DISTINCT item_id AS query_id, title FROM benchmark b, k_docs d WHERE contains(d.plain, b.text)"""


def _evaluation(name: str) -> None:
    CTE[f"first{name}"] = f"""SELECT g.query_id, min(result_rank) AS first_hit_rank FROM q_gold g
      LEFT JOIN best_{name} b ON g.query_id = b.query_id AND g.title = b.title GROUP BY 1"""
    SQL[f"retrieval_eval{name}"] = f"""SELECT count(*) AS total, round(count(first_hit_rank) / count(*)::DOUBLE, 4) AS recall_at_5,
      round(coalesce(sum(1::DOUBLE / first_hit_rank), 0) / count(*), 4) AS mrr,
      round(count(*) FILTER (WHERE first_hit_rank = 1) / count(*)::DOUBLE, 4) AS top1_accuracy FROM first{name}"""


_evaluation("")
_evaluation("_fts")
_evaluation("_vector")
SQL["retrieval_first_hits"] = "SELECT query_id, first_hit_rank, first_hit_rank IS NOT NULL AS passed FROM first"


def all_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in SQL.items()}
