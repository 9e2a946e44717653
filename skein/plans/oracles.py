"""DuckDB SQL with the same results as the queries of the same names."""

from __future__ import annotations

from skein.functions.text import FEW_STOP_WORDS, LIKE_STOP_WORDS, STOP_CHARACTERS, STOP_WORDS
from skein.operators.graph import DOT, MERMAID
from skein.operators.usage import OTHERWISE, RATES


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _case(column: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{other}' END"


WORD = r"'[\p{L}\p{N}_]+'"
VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), q AS (SELECT id AS query_id, vec AS qv FROM v WHERE id % 100 = 0)"
COSINE = f"{VECTORS}, s AS (SELECT query_id, id, round(coalesce(list_dot_product(vec, qv) / nullif(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qv, qv)), 0), 0), 6) AS similarity FROM v, q)"
ITEMS = "items AS (SELECT doc_id AS query_id, text AS query_text FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL), docs AS (SELECT doc_id AS id, text AS content FROM documents WHERE text IS NOT NULL)"


def _top(score: str, k: int, table: str, columns: str, order: str | None = None) -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order or score + ' DESC'}, id) AS rank FROM {table}) WHERE rank <= {k}"


SUBSTRING = f"""{ITEMS}, sub_q AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(query_text)), '\\s+'), lambda t: t <> '')) AS terms, lower(query_text) AS whole FROM items),
sub_s AS (SELECT query_id, id, round(100 * (len(list_filter(terms, lambda t: contains(lower(content), t))) / len(terms) + CASE WHEN contains(lower(content), whole) THEN 1.0 ELSE 0.0 END), 6) AS keyword_score FROM docs, sub_q WHERE len(terms) > 0)"""
OVERLAP = f"""ov_q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query_text), {WORD})) AS terms FROM items),
ov_s AS (SELECT query_id, id, round(len(list_filter(terms, lambda t: contains(lower(content), t))) / len(terms), 6) AS keyword_score FROM docs, ov_q WHERE len(terms) > 0)"""
BM25 = f"""bm_t AS (SELECT id, regexp_extract_all(lower(content), {WORD}) AS tokens FROM docs),
bm_n AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM bm_t),
bm_q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query_text), {WORD}))) AS word FROM items),
bm_tf AS (SELECT id, length, word, count(*) AS tf FROM (SELECT id, len(tokens) AS length, unnest(tokens) AS word FROM bm_t) WHERE word IN (SELECT word FROM bm_q) GROUP BY ALL),
bm_df AS (SELECT word, count(*) AS df FROM bm_tf GROUP BY word),
bm_s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS keyword_score FROM bm_tf JOIN bm_df USING (word) JOIN bm_q USING (word), bm_n GROUP BY query_id, id)"""
HYBRID = f"""{ITEMS}, hv AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
hq AS (SELECT query_id, query_text, vec AS qv FROM items JOIN hv ON hv.id = query_id),
hs AS (SELECT query_id, v.id, round(list_dot_product(vec, qv) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qv, qv))), 6) AS similarity FROM hv v JOIN (SELECT DISTINCT id FROM docs) d USING (id), hq),
hd AS ({_top('similarity', 50, 'hs', 'query_id, id, round(1 - similarity, 6) AS semantic_score')}),
{BM25},
hk AS ({_top('keyword_score', 50, "(SELECT * FROM bm_s WHERE keyword_score > 0 AND query_id IN (SELECT query_id FROM hq))", 'query_id, id')}),
hf AS (SELECT query_id, id, sum(part) AS raw FROM (SELECT query_id, id, 0 AS l, 4.0::DOUBLE / (60 + rank - 1) AS part FROM hd UNION ALL SELECT query_id, id, 1, 1.0::DOUBLE / (60 + rank - 1) FROM hk) GROUP BY query_id, id),
hr AS ({_top('raw', 30, 'hf', 'query_id, id, round(raw, 9) AS score')}),
found AS (SELECT hr.query_id, query_text, hr.id, content, semantic_score, score, hr.rank FROM hr JOIN hq USING (query_id) JOIN docs USING (id) LEFT JOIN hd ON hd.query_id = hr.query_id AND hd.id = hr.id)"""


def _keywords(text: str, stop: list[str]) -> str:
    return f"list_filter(list_distinct(list_concat(regexp_extract_all({text}, '[一-鿿]'), list_filter(regexp_extract_all(lower({text}), {WORD}), lambda w: regexp_matches(w, '^[a-z]{{2,}}$')))), lambda w: NOT list_contains({_list([*STOP_CHARACTERS, *stop])}, w))"


def _proper(text: str) -> str:
    return f"list_distinct(list_concat(list_concat(list_filter(regexp_extract_all({text}, {WORD}), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')), regexp_extract_all({text}, '[A-Z]{{2,}}')), regexp_extract_all({text}, '[一-鿿]{{2,}}')))"


def _terms(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(trim({text})), '\\s+'), lambda t: t <> ''))"


LENGTH = "CASE WHEN length(content) < 200 THEN 50 + 50.0::DOUBLE * length(content) / 200 WHEN length(content) <= 600 THEN 100.0::DOUBLE ELSE 100 - least(50.0::DOUBLE, (length(content) - 600) / 20.0::DOUBLE) END"


def _coverage(stop: list[str]) -> str:
    q = _keywords("query_text", stop)
    return f"CASE WHEN len({q}) > 0 THEN 100.0::DOUBLE * len(list_intersect({q}, {_keywords('content', stop)})) / len({q}) ELSE 0 END"


BONUS = f"greatest(0, 20 - rank) + CASE WHEN list_has_any({_proper('query_text')}, {_proper('content')}) THEN 30 ELSE 0 END"
OVERLAP_SCORE = f"CASE WHEN contains(lower(content), lower(query_text)) OR contains(lower(query_text), lower(content)) THEN 80.0::DOUBLE WHEN len({_terms('query_text')}) > 0 THEN 100.0::DOUBLE * len(list_intersect({_terms('query_text')}, {_terms('content')})) / len({_terms('query_text')}) ELSE 0 END"
EDGES = "e AS (SELECT DISTINCT * FROM kg_relationships), c AS (SELECT * FROM e WHERE trim(source) <> '' AND trim(target) <> '')"
BESIDE = f"{EDGES}, beside AS (SELECT source AS node, target AS nxt FROM c WHERE source <> target UNION SELECT target, source FROM c WHERE source <> target), seeds AS (SELECT DISTINCT source AS seed FROM e WHERE edge_id % 100 = 0 AND trim(source) <> '')"
KHOP = f"{BESIDE}, walk AS (SELECT seed, seed AS node, 0 AS depth FROM seeds UNION SELECT seed, nxt, depth + 1 FROM walk JOIN beside USING (node) WHERE depth < {{hops}}), reached AS (SELECT seed, node, min(depth)::INT AS depth FROM walk GROUP BY seed, node HAVING min(depth) > 0)"
V = "vx AS (SELECT name, min((coalesce(entity_type, 'Unknown'), coalesce(description, ''))) AS v FROM kg_entities WHERE name IS NOT NULL GROUP BY name)"
RECORDS = "r AS (SELECT record_id, name, entity_type FROM entity_nodes UNION ALL SELECT record_id, name, entity_type FROM kg_entities)"
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^(the|a|an)\s+', ''), '\s+(inc|llc|ltd|corp|corporation|company)\.?$', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
NAMES = f"{RECORDS}, n AS (SELECT lower(trim(coalesce(entity_type, 'unknown'))) AS entity_type, {NORMAL} AS name, min(record_id) AS record_id FROM r GROUP BY 1, 2), nn AS (SELECT * FROM n WHERE name <> '')"
DUPLICATES = f"{NAMES}, dup AS (SELECT * FROM (SELECT a.entity_type, a.name AS name_a, b.name AS name_b, round(0.8::DOUBLE + 0.2::DOUBLE * least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name)), 6) AS similarity FROM nn a JOIN nn b ON a.entity_type = b.entity_type AND a.name < b.name AND (contains(a.name, b.name) OR contains(b.name, a.name))) WHERE similarity >= 0.85)"
CLUSTERS = f"""{DUPLICATES}, links AS (SELECT entity_type, name_a AS x, name_b AS y FROM dup UNION ALL SELECT entity_type, name_b, name_a FROM dup),
comp AS (SELECT entity_type, name AS start, name FROM nn UNION SELECT comp.entity_type, start, y FROM comp JOIN links ON links.entity_type = comp.entity_type AND links.x = comp.name),
low AS (SELECT entity_type, start AS name, min(name) AS component FROM comp GROUP BY 1, 2),
clus AS (SELECT entity_type, name, first_value(name) OVER w AS canonical, count(*) OVER (PARTITION BY entity_type, component) AS members FROM low WINDOW w AS (PARTITION BY entity_type, component ORDER BY length(name) DESC, name))"""
CALLS = "u AS (SELECT DISTINCT * FROM token_usage), calls AS (SELECT call_id, coalesce(lower(trim(provider)), 'unknown') AS provider, coalesce(trim(model), 'unknown') AS model, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens FROM u)"
PRICED = (
    f"{CALLS}, rates(rp, rm, ri, ro) AS (VALUES " + ", ".join(f"('{p}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for p, m, i, o in RATES) + "), models AS (SELECT DISTINCT provider, model FROM calls), "
    "fit AS (SELECT provider, model, ri, ro, row_number() OVER (PARTITION BY provider, model ORDER BY CASE WHEN rm = model THEN 0 WHEN rm = 'default' THEN 2 ELSE 1 END, length(rm) DESC, rm) AS k FROM models LEFT JOIN rates ON provider = rp AND (rm = model OR contains(lower(model), rm) OR rm = 'default')), "
    f"priced AS (SELECT provider, model, coalesce(ri, {OTHERWISE[0]}::DOUBLE) AS input_rate, coalesce(ro, {OTHERWISE[1]}::DOUBLE) AS output_rate FROM fit WHERE k = 1)"
)
COSTS = f"{PRICED}, costs AS (SELECT calls.*, round(input_tokens / 1000 * input_rate + output_tokens / 1000 * output_rate, 6) AS cost_usd FROM calls JOIN priced USING (provider, model))"
USAGE = "count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS total_tokens, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd"
NODE = "coalesce(nullif(CASE WHEN regexp_matches(regexp_replace({0}, '[^a-zA-Z0-9_]', '_', 'g'), '^[0-9]') THEN 'n' ELSE '' END || regexp_replace({0}, '[^a-zA-Z0-9_]', '_', 'g'), ''), 'node')"
NODES = f"{EDGES}, al AS (SELECT 0 AS o, name, coalesce(entity_type, '') AS entity_type FROM kg_entities WHERE name IS NOT NULL UNION ALL SELECT 1, source, '' FROM c UNION ALL SELECT 1, target, '' FROM c), nodes AS (SELECT node, x[1] AS o, x[2] AS name, x[3] AS entity_type FROM (SELECT {NODE.format('name')} AS node, min((o, name, entity_type)) AS x FROM al GROUP BY 1))"
NODES = NODES.replace("x[1] AS o, x[2] AS name, x[3] AS entity_type", "x.o AS o, x.name AS name, x.entity_type AS entity_type").replace("min((o, name, entity_type)) AS x", "min({'o': o, 'name': name, 'entity_type': entity_type}) AS x")

ORACLES = {
    "dense_topk": f"WITH {COSINE} {_top('similarity', 10, 's', 'query_id, id, similarity, round(1 - similarity, 6) AS semantic_score')}",
    "dense_topk_blocks": f"WITH {COSINE} {_top('similarity', 10, 's', 'query_id, id, similarity')}",
    "l2_topk": f"WITH {VECTORS}, s AS (SELECT query_id, id, round(list_sum(list_transform(list_zip(vec, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM v, q) {_top('', 10, 's', 'query_id, id, distance, round(100 / (1 + distance), 6) AS raw_score', 'distance')}",
    "self_recall": f"WITH {COSINE}, f AS ({_top('similarity', 1, 's', 'query_id, id')}) SELECT count(*) AS queries, count(*) FILTER (id = query_id) AS hits, round(100.0::DOUBLE * count(*) FILTER (id = query_id) / count(*), 6) AS recall_percent FROM f",
    "keyword_substring": f"WITH {SUBSTRING} {_top('keyword_score', 50, '(SELECT * FROM sub_s WHERE keyword_score > 0)', 'query_id, id, keyword_score')}",
    "keyword_overlap": f"WITH {ITEMS}, {OVERLAP} {_top('keyword_score', 50, '(SELECT * FROM ov_s WHERE keyword_score > 0)', 'query_id, id, keyword_score')}",
    "keyword_like": f"""WITH {ITEMS}, t AS (SELECT query_id, list_filter(regexp_extract_all(lower(query_text), '[a-z0-9一-鿿]+'), lambda t: length(t) > 1 AND NOT list_contains({_list(LIKE_STOP_WORDS)}, t)) AS kept FROM items),
        q AS (SELECT query_id, list_distinct(list_concat(list_filter(kept, lambda t: regexp_matches(t, '[一-鿿]'))[1:5], list_filter(kept, lambda t: NOT regexp_matches(t, '[一-鿿]'))[1:5])) AS terms FROM t),
        s AS (SELECT query_id, id, 100.0::DOUBLE AS raw_score FROM docs JOIN q ON len(list_filter(terms, lambda t: contains(lower(content), t))) > 0) {_top('raw_score', 50, 's', 'query_id, id, raw_score')}""",
    "bm25_topk": f"WITH {ITEMS}, {BM25} {_top('keyword_score', 50, '(SELECT * FROM bm_s WHERE keyword_score > 0)', 'query_id, id, keyword_score')}",
    "hybrid_search": f"WITH {HYBRID} SELECT query_id, id, score, semantic_score, rank FROM found",
    "rerank_multifactor": f"""WITH {HYBRID}, s AS (SELECT query_id, id, round(0.25::DOUBLE * ({OVERLAP_SCORE}) + 0.25::DOUBLE * ({_coverage(STOP_WORDS)}) + 0.35::DOUBLE * CASE WHEN semantic_score > 0 THEN 100 / (1 + 0.1::DOUBLE * semantic_score) ELSE 80.0::DOUBLE END + 0.15::DOUBLE * ({LENGTH}) + {BONUS}, 6) AS composite_score FROM found)
        {_top('composite_score', 10, 's', 'query_id, id, composite_score')}""",
    "rerank_composite": f"""WITH {HYBRID}, p AS (SELECT *, round(CASE WHEN contains(content, query_text) OR contains(query_text, content) THEN 80 + 20::DOUBLE * least(length(query_text), length(content)) / greatest(length(query_text), length(content), 1) ELSE 50.0::DOUBLE END, 6) AS fuzzy, round({_coverage(FEW_STOP_WORDS)}, 6) AS kw, round(CASE WHEN semantic_score IS NULL THEN 80.0::DOUBLE ELSE 100 / (1 + 0.1::DOUBLE * semantic_score) END, 6) AS vec FROM found),
        s AS (SELECT query_id, id, fuzzy, kw, vec, round(0.25::DOUBLE * fuzzy + 0.25::DOUBLE * kw + 0.35::DOUBLE * vec + 0.15::DOUBLE * ({LENGTH}) + {BONUS}, 6) AS composite_score FROM p) {_top('composite_score', 10, 's', 'query_id, id, fuzzy, kw, vec, composite_score')}""",
    "rrf_three_lists": f"""WITH {SUBSTRING}, {OVERLAP}, {BM25}, l AS (
        SELECT query_id, id, 0 AS list, 4.0::DOUBLE / (60 + rank - 1) AS part FROM ({_top('keyword_score', 50, '(SELECT * FROM sub_s WHERE keyword_score > 0)', 'query_id, id')})
        UNION ALL SELECT query_id, id, 1, 1.0::DOUBLE / (60 + rank - 1) FROM ({_top('keyword_score', 50, '(SELECT * FROM ov_s WHERE keyword_score > 0)', 'query_id, id')})
        UNION ALL SELECT query_id, id, 2, 2.0::DOUBLE / (60 + rank - 1) FROM ({_top('keyword_score', 50, '(SELECT * FROM bm_s WHERE keyword_score > 0)', 'query_id, id')})),
        s AS (SELECT query_id, id, list_reduce(list(part ORDER BY list), lambda a, b: a + b) AS raw, min(list) AS first_list FROM l GROUP BY query_id, id) {_top('raw', 20, 's', 'query_id, id, round(raw, 9) AS score, first_list')}""",
    "context_citations": f"WITH {ITEMS}, {BM25}, t AS ({_top('keyword_score', 5, '(SELECT * FROM bm_s WHERE keyword_score > 0)', 'query_id, id')}) SELECT query_id, string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN docs USING (id) GROUP BY query_id",
    "context_detailed": f"WITH {ITEMS}, {OVERLAP}, t AS ({_top('keyword_score', 5, '(SELECT * FROM ov_s WHERE keyword_score > 0)', 'query_id, id, keyword_score')}) SELECT query_id, string_agg('[' || rank || '] Source: ' || coalesce(file_path, 'unknown') || ' [Relevance: ' || printf('%.1f', keyword_score * 100) || '%]' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN documents ON doc_id = id GROUP BY query_id",
    "context_budget": f"WITH {ITEMS}, {BM25}, t AS ({_top('keyword_score', 50, '(SELECT * FROM bm_s WHERE keyword_score > 0)', 'query_id, id')}) SELECT * FROM (SELECT query_id, id, rank, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used_chars FROM t JOIN docs USING (id)) WHERE used_chars <= 8000",
    "dedup_sha256": "SELECT min(doc_id) AS doc_id, sha256(content) AS content_hash FROM store_documents GROUP BY content",
    "stale_hashes": "SELECT coalesce(lower(doc_type), 'unknown') AS doc_type, CASE WHEN content_hash IS NULL THEN 'missing' WHEN lower(content_hash) = substr(sha256(content), 1, 16) THEN 'current' ELSE 'stale' END AS state, count(*) AS n FROM store_documents GROUP BY 1, 2",
    "doc_stats_by_type": "SELECT coalesce(lower(doc_type), 'unknown') AS doc_type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM store_documents GROUP BY 1",
    "ingest_only_new": "SELECT min(doc_id) AS doc_id FROM documents WHERE trim(text, ' ') <> '' AND text NOT IN (SELECT content FROM store_documents) GROUP BY text",
    "already_stored": "SELECT id FROM multimodal_documents WHERE content IN (SELECT content FROM store_documents)",
    "manifest_diff": """WITH o AS (SELECT file_path AS path, min(created_at) AS b FROM documents WHERE file_path IS NOT NULL GROUP BY 1 HAVING min(created_at) IS NOT NULL), n AS (SELECT file_path AS path, max(ingested_at) AS a FROM documents WHERE file_path IS NOT NULL GROUP BY 1 HAVING max(ingested_at) IS NOT NULL)
        SELECT path, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'deleted' WHEN a > b THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL JOIN n USING (path)""",
    "blend_first_wins": "WITH a AS (SELECT content, doc_id AS item, 'store' AS origin, 0 AS p FROM store_documents UNION ALL SELECT text, doc_id::VARCHAR, 'corpus', 1 FROM documents WHERE text IS NOT NULL) SELECT item, origin FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY p, item) AS k FROM a) WHERE k = 1",
    "upsert_by_id": "WITH g AS (SELECT name, min({'record_id': record_id, 'entity_type': entity_type}) AS x FROM kg_entities GROUP BY name), a AS (SELECT record_id, entity_type FROM entity_nodes WHERE name IS NULL OR name NOT IN (SELECT name FROM g WHERE name IS NOT NULL) UNION ALL SELECT x.record_id, x.entity_type FROM g) SELECT coalesce(entity_type, 'none') AS entity_type, count(*) AS n, sum(record_id)::BIGINT AS ids FROM a GROUP BY 1",
    "delete_by_file": "SELECT coalesce(collection_name, 'none') AS collection_name, count(*) AS n FROM documents WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM documents WHERE doc_type = 'pdf' AND file_path IS NOT NULL) GROUP BY 1",
    "list_files": "SELECT DISTINCT file_path FROM documents WHERE file_path IS NOT NULL",
    "document_reassembly": "WITH r AS (SELECT file_path, doc_id, text, row_number() OVER (PARTITION BY file_path ORDER BY doc_id) AS k FROM documents WHERE file_path IS NOT NULL AND text IS NOT NULL), t AS (SELECT file_path, string_agg(text, chr(10) || chr(10) ORDER BY k) AS x FROM r WHERE k <= 1000 GROUP BY 1) SELECT file_path, md5(x) AS content_md5, length(x) AS chars FROM t",
    "documents_left_embeddings": "SELECT coalesce(lower(lang), 'none') AS lang, count(*) AS docs, count(label) AS with_vector FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1",
    "usable_vectors": "SELECT coalesce(collection_name, 'none') AS collection_name, count(*) AS n FROM multimodal_documents WHERE len(embedding) = 96 GROUP BY 1",
    "metadata_filter": "WITH m AS (SELECT doc_id, CASE WHEN json_valid(metadata) THEN metadata END AS j FROM store_documents), p AS (SELECT doc_id, TRY_CAST(json_extract_string(j, '$.page') AS INT) AS page, json_extract_string(j, '$.source') AS source FROM m) SELECT * FROM p WHERE page BETWEEN 1 AND 20",
    "chunk_headers": r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM store_documents),
        g AS (SELECT id, line, k, sum(CASE WHEN k = 1 OR regexp_matches(line, '^[\s\p{Z}]*#') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS part FROM l),
        t AS (SELECT id, part, string_agg(line, chr(10) ORDER BY k) AS chunk FROM g GROUP BY id, part HAVING regexp_replace(string_agg(line, chr(10) ORDER BY k), '\s+', '', 'g') <> '')
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY part)::INT AS chunk_no, md5(chunk) AS chunk_md5 FROM t""",
    "chunk_fixed": "WITH s AS (SELECT doc_id AS id, content, unnest(range(0, greatest(0, ceil((length(content) - 1000) / 800.0))::BIGINT + 1)) AS i FROM store_documents) SELECT id, (i + 1)::INT AS chunk_no, md5(substr(content, (i * 800 + 1)::BIGINT, 1000)) AS chunk_md5 FROM s WHERE substr(content, (i * 800 + 1)::BIGINT, 1000) <> ''",
    "chunk_paragraphs": r"WITH l AS (SELECT doc_id AS id, unnest(string_split(content, chr(10) || chr(10))) AS p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS k FROM store_documents), t AS (SELECT id, k, regexp_replace(p, '^\s+|\s+$', '', 'g') AS chunk FROM l WHERE regexp_replace(p, '^\s+|\s+$', '', 'g') <> '') SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS chunk_no, md5(chunk) AS chunk_md5 FROM t",
    "csv_rows": r"""WITH l AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x, ' ') <> '') AS ls FROM documents WHERE doc_type = 'csv' AND text IS NOT NULL),
        r AS (SELECT id, string_split(ls[1], ',') AS h, unnest(ls[2:]) AS line, generate_subscripts(ls[2:], 1) AS k FROM l),
        t AS (SELECT id, k, list_aggregate(list_filter(list_transform(range(1, least(len(h), len(string_split(line, ','))) + 1), lambda i: CASE WHEN trim(string_split(line, ',')[i], ' ') <> '' THEN trim(h[i], ' ') || ': ' || trim(string_split(line, ',')[i], ' ') END), lambda x: x IS NOT NULL), 'string_agg', ' | ') AS chunk FROM r)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS chunk_no, chunk FROM t WHERE chunk <> ''""",
    "code_blocks": r"""WITH b AS (SELECT doc_id AS id, CASE WHEN len(regexp_extract_all(text, '(?s)```python\s*\n(.*?)```', 1)) > 0 THEN regexp_extract_all(text, '(?s)```python\s*\n(.*?)```', 1) ELSE regexp_extract_all(text, '(?s)```[a-z]*\s*\n(.*?)```', 1) END AS c FROM documents WHERE text IS NOT NULL)
        SELECT id, (generate_subscripts(c, 1) - 1)::INT AS n, unnest(c) AS code FROM b""",
    "keyword_counts": f"SELECT doc_id AS id, len({_keywords('text', STOP_WORDS)}) AS keywords, len({_proper('text')}) AS proper_nouns, len(list_distinct(regexp_extract_all(lower(text), {WORD}))) AS words FROM documents WHERE text IS NOT NULL",
    "token_estimate": "SELECT coalesce(lower(lang), 'none') AS lang, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY 1",
    "response_quality": r"SELECT doc_id AS id, least(1.0::DOUBLE, round(CASE WHEN length(text) BETWEEN 300 AND 3000 THEN 0.3::DOUBLE WHEN length(text) > 100 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + " + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END" for p in (r"(?m)^#+\s", r"(?m)^\s*[-*]\s", r"(?m)^\s*\d+\.\s", r"\*\*.*?\*\*")) + " + CASE WHEN len(regexp_extract_all(text, '[.!?]+')) >= 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(regexp_extract_all(text, '[.!?]+')) >= 6 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 6)) AS quality FROM documents WHERE text IS NOT NULL",
    "final_answer_parse": "SELECT item_id, answer AS final_answer, CASE WHEN answer IS NOT NULL THEN 'result_' || item_id END AS variable FROM eval_items",
    "report_grades": "SELECT score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END AS grade, count(*) AS n FROM (SELECT (floor(abs(value))::BIGINT % 101)::INT AS score FROM events WHERE value IS NOT NULL) GROUP BY 1, 2",
    "sub_queries": r"""WITH q AS (SELECT item_id AS query_id, text AS query_text FROM eval_items WHERE text IS NOT NULL), s AS (SELECT query_id, trim(unnest(regexp_split_to_array(query_text, '\. ')), ' ') AS text, generate_subscripts(regexp_split_to_array(query_text, '\. '), 1) AS pos FROM q),
        g AS (SELECT query_id, text, min(pos) AS pos FROM s WHERE length(text) > 10 AND NOT regexp_matches(lower(text), '^(sub-query|example|note|here are)') GROUP BY 1, 2), r AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY pos, text)::INT AS part FROM g)
        SELECT query_id, 0 AS part, md5(query_text) AS query_md5 FROM q UNION ALL SELECT query_id, part, md5(text) FROM r WHERE part <= 3""",
    "graph_parse": r"""WITH l AS (SELECT doc_id AS id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents WHERE text IS NOT NULL),
        m AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^(\*\*Entities\*\*|## Entities)') THEN 'e' WHEN regexp_matches(line, '^(\*\*Relationships\*\*|## Relationships)') THEN 'r' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no) AS section FROM l)
        SELECT id, line_no, 'entity' AS kind, coalesce(nullif(regexp_extract(line, '^- (?:\*\*(.+?)\*\*|([^(*]+?)) \(([^)]*)\): ?(.*)$', 1), ''), regexp_extract(line, '^- (?:\*\*(.+?)\*\*|([^(*]+?)) \(([^)]*)\): ?(.*)$', 2)) AS a, regexp_extract(line, '^- (?:\*\*(.+?)\*\*|([^(*]+?)) \(([^)]*)\): ?(.*)$', 3) AS b, regexp_extract(line, '^- (?:\*\*(.+?)\*\*|([^(*]+?)) \(([^)]*)\): ?(.*)$', 4) AS c FROM m WHERE section = 'e' AND regexp_matches(line, '^- (?:\*\*(.+?)\*\*|([^(*]+?)) \(([^)]*)\): ?(.*)$')
        UNION ALL SELECT id, line_no, 'relation', trim(regexp_extract(line, '^- (.+?) → (.+?) → (.+?)(?: \(([^)]*)\))?$', 1), ' '), trim(regexp_extract(line, '^- (.+?) → (.+?) → (.+?)(?: \(([^)]*)\))?$', 2), ' '), trim(regexp_extract(line, '^- (.+?) → (.+?) → (.+?)(?: \(([^)]*)\))?$', 3), ' ') FROM m WHERE section = 'r' AND regexp_matches(line, '^- (.+?) → (.+?) → (.+?)(?: \(([^)]*)\))?$')""",
    "graph_adjacency": f"WITH {EDGES}, a AS (SELECT source AS node, relation, target AS neighbour, context FROM c UNION SELECT target, 'inverse_' || coalesce(relation, ''), source, context FROM c) SELECT node, count(*) AS edges, count(DISTINCT neighbour) AS neighbours FROM a GROUP BY node",
    "graph_khop": f"WITH RECURSIVE {KHOP.format(hops=3)} SELECT seed, node, depth FROM reached",
    "graph_described": f"WITH RECURSIVE {KHOP.format(hops=2)}, {V} SELECT seed, node, depth, coalesce(v[1], 'Unknown') AS entity_type, coalesce(v[2], '') AS description FROM reached LEFT JOIN vx ON vx.name = node",
    "graph_paths": f"""WITH {EDGES}, p AS (SELECT DISTINCT source, target FROM c WHERE edge_id % 100 = 0 AND source <> target), d AS (SELECT DISTINCT source AS x, coalesce(relation, '') AS r, target AS y FROM c WHERE source <> target)
        SELECT p.source, p.target, p.source || ' > ' || d.r || ' > ' || d.y AS path FROM p JOIN d ON d.x = p.source AND d.y = p.target
        UNION ALL SELECT p.source, p.target, p.source || ' > ' || a.r || ' > ' || a.y || ' > ' || b.r || ' > ' || b.y FROM p JOIN d a ON a.x = p.source JOIN d b ON b.x = a.y AND b.y = p.target WHERE a.y <> p.target AND a.y <> p.source
        UNION ALL SELECT p.source, p.target, p.source || ' > ' || a.r || ' > ' || a.y || ' > ' || b.r || ' > ' || b.y || ' > ' || f.r || ' > ' || f.y FROM p JOIN d a ON a.x = p.source JOIN d b ON b.x = a.y JOIN d f ON f.x = b.y AND f.y = p.target
        WHERE a.y NOT IN (p.target, p.source) AND b.y NOT IN (p.target, p.source, a.y)""",
    "graph_stats": "SELECT entities, relationships, round(relationships / greatest(entities, 1), 6) AS connected_ratio FROM (SELECT count(*) AS entities FROM kg_entities), (SELECT count(*) AS relationships FROM (SELECT DISTINCT * FROM kg_relationships))",
    "graph_types": "SELECT coalesce(entity_type, 'Unknown') AS entity_type, count(*) AS n FROM kg_entities GROUP BY 1",
    "graph_collapsed": f"WITH {EDGES} SELECT edge_id, source, relation, target, context FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY edge_id DESC) AS k FROM c) WHERE k = 1",
    "graph_mermaid": f"WITH {NODES} SELECT 0 AS part, 'graph TD' AS line UNION ALL SELECT 1, '    ' || node || '[\"' || name || '\"]' || CASE WHEN o = 0 THEN chr(10) || '    style ' || node || ' fill:' || {_case('entity_type', MERMAID, '#f5f5f5')} ELSE '' END FROM nodes UNION ALL SELECT 2, '    ' || {NODE.format('source')} || ' -->|\"' || replace(coalesce(relation, ''), '\"', '&quot;') || '\"| ' || {NODE.format('target')} FROM c",
    "graph_dot": f"WITH {NODES} SELECT 0 AS part, 'digraph KnowledgeGraph {{' || chr(10) || '    rankdir=LR;' AS line UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '    ' || node || ' [label=\"' || replace(name, '\"', '\\\"') || '\", fillcolor=' || CASE WHEN o = 0 THEN {_case('entity_type', DOT, 'white')} ELSE 'white' END || ', style=filled];' FROM nodes UNION ALL SELECT 2, '    ' || {NODE.format('source')} || ' -> ' || {NODE.format('target')} || ' [label=\"' || replace(coalesce(relation, ''), '\"', '\\\"') || '\"];' FROM c",
    "seed_phrases": "WITH p AS (SELECT doc_id AS id, list_distinct(list_concat(regexp_extract_all(text, '[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+){1,3}'), regexp_extract_all(text, '\"([^\"]{2,30})\"', 1))) AS x FROM documents WHERE text IS NOT NULL) SELECT id, unnest(x) AS phrase FROM p",
    "entity_normalize": f"WITH {RECORDS} SELECT record_id, {NORMAL} AS normal_name FROM r",
    "entity_duplicates": f"WITH {DUPLICATES} SELECT entity_type, name_a, name_b, similarity FROM dup",
    "entity_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT entity_type, name, canonical, members FROM clus",
    "entity_report": f"WITH RECURSIVE {CLUSTERS} SELECT count(*) AS names, count(DISTINCT (entity_type, canonical)) AS canonical_names, count(DISTINCT CASE WHEN members > 1 THEN (entity_type, canonical) END) AS merged_groups FROM clus",
    "entity_renamed_edges": f"WITH RECURSIVE {EDGES}, {CLUSTERS}, cn AS (SELECT name, min(canonical) AS canonical FROM clus GROUP BY name), s AS (SELECT {NORMAL.replace('name', 'source')} AS a, {NORMAL.replace('name', 'target')} AS b FROM e) SELECT coalesce(x.canonical, a) AS source, coalesce(y.canonical, b) AS target, count(*) AS n FROM s LEFT JOIN cn x ON x.name = a LEFT JOIN cn y ON y.name = b GROUP BY 1, 2",
    "collection_slugs": r"SELECT name, nullif(regexp_replace(replace(lower(trim(display_name, ' ')), ' ', '-'), '[^\p{L}\p{N}_-]', '', 'g'), '') AS slug FROM collections",
    "collection_stats": "SELECT name, coalesce(document_count, 0) AS document_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(len(sources), 0) AS source_count, coalesce(len(tags), 0) AS tag_count, coalesce(len(model_history), 0) AS model_changes, datediff('day', TRY_CAST(substr(created, 1, 10) AS DATE), DATE '2026-01-01') AS age_days, coalesce(trim(description, ' '), '') <> '' AS has_description FROM collections",
    "collection_totals": "SELECT count(*) AS collections, coalesce(sum(document_count), 0)::BIGINT AS documents, coalesce(sum(chunk_count), 0)::BIGINT AS chunks, round(avg(coalesce(document_count, 0)), 6) AS mean_documents, round(avg(coalesce(chunk_count, 0)), 6) AS mean_chunks, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM collections)) AS unique_tags FROM collections",
    "model_distribution": "SELECT coalesce(nullif(trim(embedding_model, ' '), ''), 'unknown') AS embedding_model, count(*) AS n FROM collections GROUP BY 1",
    "tag_distribution": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM collections) GROUP BY tag",
    "collection_search": "SELECT name, document_count FROM collections WHERE contains(lower(concat_ws(chr(10), name, display_name, description)), 'a') AND coalesce(document_count, 0) BETWEEN 10 AND 500",
    "collection_models": "WITH m AS (SELECT name, coalesce(embedding_model, '') AS current, list_sort(list_distinct(list_filter(list_transform(coalesce(sources, []), lambda s: s.embedding_model), lambda x: coalesce(x, '') <> ''))) AS l FROM collections) SELECT name, current IN ('', 'hashing-64') AS compatible, len(l) > 1 AS mixed, array_to_string(l, ',') AS models FROM m",
    "collection_recount": "SELECT c.name, coalesce(document_count, 0) AS recorded, coalesce(held, 0) AS held FROM collections c LEFT JOIN (SELECT collection_name AS name, count(*) AS held FROM store_documents GROUP BY 1) USING (name)",
    "usage_totals": f"WITH {COSTS} SELECT {USAGE} FROM costs",
    "usage_by_provider": f"WITH {COSTS} SELECT provider, {USAGE} FROM costs GROUP BY provider",
    "usage_by_model": f"WITH {COSTS} SELECT model, {USAGE} FROM costs GROUP BY model",
    "usage_rates": f"WITH {PRICED} SELECT provider, model, input_rate, output_rate FROM priced",
    "quality_plateaus": """WITH t AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, least(1.0::DOUBLE, abs(value) / 100) AS quality FROM events),
        l AS (SELECT *, lag(quality, 1) OVER w AS one, lag(quality, 2) OVER w AS two FROM t WINDOW w AS (PARTITION BY run_id ORDER BY iteration)) SELECT run_id, min(iteration)::INT AS stopped_at FROM l WHERE abs(quality - one) < 0.1 AND abs(one - two) < 0.1 AND quality > 0.7 AND iteration > 2 GROUP BY run_id""",
    "hashed_embeddings": f"WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), {WORD})) AS t FROM documents WHERE text IS NOT NULL) SELECT dim, count(DISTINCT id) AS n FROM (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64)::INT AS dim FROM w) GROUP BY dim",
}

MEDIA = "mv AS (SELECT id, content, image_path, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM multimodal_documents WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0), mq AS (SELECT id AS query_id, vec AS qv FROM mv WHERE substr(id, 4)::BIGINT % 100 = 0 AND list_dot_product(vec, vec) > 0), ms AS (SELECT query_id, id, round(coalesce(list_dot_product(vec, qv) / nullif(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qv, qv)), 0), 0), 6) AS similarity FROM mv JOIN mq ON len(vec) = len(qv))"
BM25_5 = _top("keyword_score", 5, "(SELECT * FROM bm_s WHERE keyword_score > 0)", "query_id, id, keyword_score")
NL2 = "chr(10) || chr(10)"
BLANK = r"regexp_replace({0}, '[\s\p{{Z}}]+', '', 'g') <> ''"
MULTI = "round(0.25::DOUBLE * ({fuzzy}) + 0.25::DOUBLE * ({cover}) + 0.35::DOUBLE * CASE WHEN semantic_score > 0 THEN 100 / (1 + 0.1::DOUBLE * semantic_score) ELSE 80.0::DOUBLE END + 0.15::DOUBLE * ({length}) + {bonus}, 6) AS composite_score".format(fuzzy=OVERLAP_SCORE, cover=_coverage(STOP_WORDS), length=LENGTH, bonus=BONUS)
DENSE_ONLY = HYBRID[: HYBRID.index("hd AS (")] + f"hd AS ({_top('similarity', 100, 'hs', 'query_id, id, round(1 - similarity, 6) AS semantic_score')}), dr AS (SELECT hd.query_id, query_text, hd.id, content, semantic_score, rank FROM hd JOIN hq USING (query_id) JOIN docs USING (id))"
# what a graph gives for a seed: the first nodes by hop, their kind, description and first neighbours
GRAPH_TEXT = f"""{KHOP.format(hops=2)}, {V},
gd AS (SELECT seed, node, depth, coalesce(v[1], 'Unknown') AS kind, coalesce(v[2], '') AS description FROM reached LEFT JOIN vx ON vx.name = node),
ga AS (SELECT source AS node, coalesce(relation, '') AS relation, target AS neighbour FROM c UNION SELECT target, 'inverse_' || coalesce(relation, ''), source FROM c),
gr AS (SELECT node, string_agg(neighbour || ' (' || relation || ')', ', ' ORDER BY k) AS names FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY relation, neighbour) AS k FROM ga) WHERE k <= 3 GROUP BY node),
gk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS k, lag(depth) OVER (PARTITION BY seed ORDER BY depth, node) AS before FROM gd QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node) <= 15),
gl AS (SELECT seed, k, CASE WHEN before IS NULL THEN '**Hop ' || depth || ' Connections:**' || chr(10) WHEN before < depth THEN chr(10) || '**Hop ' || depth || ' Connections:**' || chr(10) ELSE '' END || '- **' || node || '** (' || kind || ')' || CASE WHEN description <> '' THEN chr(10) || '  - Description: ' || description ELSE '' END || CASE WHEN depth < 2 AND names IS NOT NULL THEN chr(10) || '  - Related: ' || names ELSE '' END AS line FROM gk LEFT JOIN gr USING (node)),
gt AS (SELECT seed, chr(10) || '### Graph-Augmented Context' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY k) || chr(10) AS context FROM gl GROUP BY seed)"""
PHRASES = "list_distinct(list_concat(regexp_extract_all({0}, '[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+){{1,3}}'), regexp_extract_all({0}, '\"([^\"]{{2,30}})\"', 1)))"

ORACLES |= {
    "dense_filtered": f"WITH {VECTORS}, s AS (SELECT query_id, v.id, round(coalesce(list_dot_product(vec, qv) / nullif(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qv, qv)), 0), 0), 6) AS similarity FROM v JOIN (SELECT vec_id AS id FROM embeddings WHERE label < 5) USING (id), q WHERE v.id <> query_id) {_top('similarity', 10, 's', 'query_id, id, similarity, round(1 - similarity, 6) AS semantic_score')}",
    "keyword_filtered": ORACLES["keyword_like"].replace("FROM docs JOIN q ON", "FROM docs JOIN (SELECT doc_id AS id FROM documents WHERE lower(doc_type) IN ('markdown', 'text')) USING (id) JOIN q ON"),
    "multimodal_dense": f"WITH {MEDIA} {_top('similarity', 10, '(SELECT * FROM ms WHERE id <> query_id)', 'query_id, id, similarity')}",
    "multimodal_images": f"WITH {MEDIA}, f AS ({_top('similarity', 5, 'ms', 'query_id, id')}), i AS (SELECT DISTINCT query_id, rank, id, m.image_path FROM f JOIN multimodal_documents m USING (id) WHERE trim(m.image_path) <> '') SELECT query_id, id, image_path, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, image_path) AS n FROM i) WHERE n <= 3",
    "hybrid_fused": f"WITH {HYBRID[: HYBRID.index('hr AS (')]} wd AS (SELECT DISTINCT query_id FROM hk) SELECT query_id, id, round(raw, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM hf WHERE query_id IN (FROM wd) UNION ALL SELECT query_id, id, 1 - semantic_score, rank FROM hd WHERE query_id NOT IN (FROM wd)",
    "dense_reranked": f"WITH {DENSE_ONLY}, s AS (SELECT query_id, id, {MULTI} FROM dr) {_top('composite_score', 10, 's', 'query_id, id, composite_score')}",
    "reordered": f"WITH {COSINE}, f AS ({_top('similarity', 10, 's', 'query_id, id')}) {_top('composite_score', 5, '(SELECT query_id, id, (id % 7) * 100.0::DOUBLE AS composite_score FROM f)', 'query_id, id, composite_score')}",
    "rerank_provider": f"""WITH {HYBRID}, w AS (SELECT query_id, id, list_distinct(regexp_extract_all(lower(query_text), {WORD})) AS a, list_distinct(regexp_extract_all(lower(content), {WORD})) AS b, trim(query_text) = '' AS blank FROM found),
        s AS (SELECT query_id, id, CASE WHEN blank OR len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS score FROM w) {_top('score', 10, 's', 'query_id, id, round(100 * score, 6) AS composite_score')}""",
    "without_blank": f"SELECT id FROM multimodal_documents WHERE {BLANK.format('content')}",
    "point_get": "SELECT doc_id, md5(content) AS content_md5, doc_type FROM store_documents WHERE doc_id = 'doc-0000000007'",
    "store_cleared": "SELECT 0::BIGINT AS n",
    "store_transcripts": f"SELECT doc_id FROM store_documents WHERE lower(doc_type) IN ('audio', 'transcript') AND {BLANK.format('content')}",
    "store_settings": "SELECT name AS key, CASE WHEN trim(embedding_model, ' ') <> '' THEN embedding_model ELSE 'none' END AS value FROM collections",
    "stores_merged": "SELECT doc_id AS id, md5(text) AS content_md5 FROM documents UNION ALL SELECT vec_id + (SELECT max(doc_id) + 1 FROM documents), NULL FROM embeddings",
    "context_simple": f"WITH {ITEMS}, {BM25}, t AS ({BM25_5}) SELECT query_id, string_agg(content, {NL2} ORDER BY rank) AS context FROM t JOIN docs USING (id) GROUP BY query_id",
    "context_numbered": f"WITH {ITEMS}, {OVERLAP}, t AS ({_top('keyword_score', 5, '(SELECT * FROM ov_s WHERE keyword_score > 0)', 'query_id, id, keyword_score')}) SELECT query_id, substr('## Entities' || {NL2} || string_agg('[Source ' || rank || '] (score: ' || printf('%.1f', keyword_score * 100) || ')' || chr(10) || content, {NL2} ORDER BY rank), 1, 4000) AS context FROM t JOIN docs USING (id) GROUP BY query_id",
    "context_metadata": f"WITH {ITEMS}, {BM25}, t AS ({BM25_5}) SELECT query_id, string_agg('[Document ' || rank || ']' || chr(10) || text || chr(10) || 'Metadata: ' || coalesce(source, '{{}}'), {NL2} ORDER BY rank) AS context FROM t JOIN documents ON doc_id = id GROUP BY query_id",
    "context_references": f"WITH {ITEMS}, {BM25}, t AS ({BM25_5}) SELECT query_id, string_agg('[Ref ' || rank || ' (' || coalesce(file_path, 'unknown') || ')] ' || substr(replace(text, chr(10), ' '), 1, 800), chr(10) ORDER BY rank) AS context FROM t JOIN documents ON doc_id = id GROUP BY query_id",
    "content_previews": "SELECT doc_id AS id, md5(CASE WHEN length(content) > 120 THEN substr(content, 1, 120) || '...' ELSE content END) AS preview_md5 FROM store_documents",
    "graph_extraction_inputs": "SELECT doc_id AS id, md5(substr(text, 1, greatest(2000, 25000 // (SELECT count(*) FROM documents))::BIGINT)) AS content_md5 FROM documents",
    "unified_contexts": f"""WITH RECURSIVE {HYBRID}, us AS (SELECT query_id, id, {MULTI} FROM found), ut AS ({_top('composite_score', 10, 'us', 'query_id, id, composite_score')}),
        uc AS (SELECT query_id, substr('## Knowledge Graph' || {NL2} || string_agg('[Source ' || rank || '] (score: ' || printf('%.1f', composite_score) || ')' || chr(10) || content, {NL2} ORDER BY rank), 1, 12000) AS context FROM ut JOIN docs USING (id) GROUP BY query_id),
        up AS (SELECT query_id, unnest({PHRASES.format('query_text')}) AS seed FROM hq), {GRAPH_TEXT.replace("SELECT DISTINCT source AS seed FROM e WHERE edge_id % 100 = 0 AND trim(source) <> ''", "SELECT DISTINCT seed FROM up")},
        um AS (SELECT query_id, string_agg(context, '' ORDER BY seed) AS more FROM up JOIN gt USING (seed) GROUP BY query_id), ux AS (SELECT query_id, substr(context || coalesce(more, ''), 1, 12000) AS context FROM hq LEFT JOIN uc USING (query_id) LEFT JOIN um USING (query_id))
        SELECT query_id, md5(context) AS context_md5, length(context) AS chars FROM ux""",
    "blended_search": f"WITH {ITEMS.replace('docs AS (SELECT doc_id AS id, text AS content FROM documents WHERE text IS NOT NULL)', 'bl AS (SELECT content, doc_id AS id, 0 AS p FROM store_documents UNION ALL SELECT text, doc_id::VARCHAR, 1 FROM documents WHERE text IS NOT NULL), docs AS (SELECT id, content FROM bl QUALIFY row_number() OVER (PARTITION BY content ORDER BY p, id) = 1)')}, {BM25} {_top('keyword_score', 10, '(SELECT * FROM bm_s WHERE keyword_score > 0)', 'query_id, id, keyword_score')}",
    "entity_groups": f"WITH RECURSIVE {CLUSTERS} SELECT entity_type, canonical, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM clus WHERE members > 1 GROUP BY 1, 2",
    "collection_listed": "SELECT row_number() OVER (ORDER BY name, display_name) AS position, name, display_name FROM collections WHERE trim(name, ' ') <> '' AND name <> 'field-notes'",
    "collection_saved": "SELECT CASE WHEN length(name) % 4 = 0 THEN 'new' ELSE embedding_model END AS embedding_model, count(*) AS n FROM collections GROUP BY 1",
    "collection_reindex": "WITH s AS (SELECT name, unnest(sources).path AS path, generate_subscripts(sources, 1) - 1 AS k FROM collections) SELECT name, min(k)::INT AS position, path, 0::BIGINT AS \"left\" FROM s WHERE path IS NOT NULL GROUP BY name, path",
    "collection_usage": "WITH h AS (SELECT collection_name AS name, count(*) AS items, sum(strlen(content)) AS bytes, bool_or(trim(image_path, ' ') <> '') AS images FROM store_documents GROUP BY 1), g AS (SELECT collection_name AS name, count(*) AS n FROM (SELECT DISTINCT * FROM kg_relationships) JOIN store_documents USING (doc_id) GROUP BY 1) SELECT c.name, coalesce(items, 0) AS items, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(items, 0) > 0 AS has_items, coalesce(images, false) AS has_images, coalesce(n, 0) AS graph_edges FROM collections c LEFT JOIN h USING (name) LEFT JOIN g USING (name)",
    "collection_graphs": f"SELECT collection_name AS name, md5(string_agg(text, {NL2} || '---' || {NL2} ORDER BY doc_id)) AS graph_md5 FROM documents WHERE contains(text, '## Entities') AND collection_name IS NOT NULL GROUP BY 1",
    "collection_search_tags": "SELECT name FROM collections WHERE list_has_any(tags, ['monthly', 'quiet']) AND contains(lower(embedding_model), 'mini')",
    "collection_tags": "SELECT name, array_to_string(list_filter(list_concat(t, list_filter(['field-notes', 'draft'], lambda x: NOT list_contains(t, x))), lambda x: x <> 'draft'), ',') AS tags FROM (SELECT name, list_filter(coalesce(tags, []), lambda x, i: list_position(coalesce(tags, []), x) = i) AS t FROM collections)",
    "answers_in_texts": r"""SELECT count(*) AS texts, count(*) FILTER (regexp_matches(text, '(?s)FINAL\((\"[^\"]+\"|''[^'']+'')\)')) AS answers, count(*) FILTER (regexp_matches(text, 'FINAL_VAR\(\s*[A-Za-z_][A-Za-z0-9_]*\s*\)')) AS variables, count(*) FILTER (regexp_matches(text, '\d{1,3}\s*/\s*100') OR regexp_matches(text, '(?i)score[:\s]+\d{1,3}')) AS scores FROM documents WHERE text IS NOT NULL""",
    "graph_context": f"WITH RECURSIVE {GRAPH_TEXT} SELECT seed, context FROM gt",
    "graph_augment": f"""WITH RECURSIVE tx AS (SELECT record_id AS id, 'Tell me of "' || name || '".' AS t FROM kg_entities WHERE record_id % 100 = 0 AND name IS NOT NULL), up AS (SELECT DISTINCT id, unnest({PHRASES.format('t')}) AS seed FROM tx), {GRAPH_TEXT.replace("SELECT DISTINCT source AS seed FROM e WHERE edge_id % 100 = 0 AND trim(source) <> ''", "SELECT DISTINCT seed FROM up")} SELECT id, seed, context FROM up JOIN gt USING (seed)""",
    "coreference": r"""WITH RECURSIVE en AS (SELECT doc_id AS id, list_sort(list_distinct(list(name))) AS es FROM entity_nodes WHERE doc_id IS NOT NULL AND name IS NOT NULL GROUP BY 1),
        ws AS (SELECT doc_id AS id, coalesce(es, []) AS es, list_filter(regexp_split_to_array(content, '[\s\p{Z}]+'), lambda w: w <> '') AS w FROM store_documents LEFT JOIN en ON en.id = doc_id),
        tk AS (SELECT id, es, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM ws),
        tb AS (SELECT id, es, pos, word, regexp_replace(regexp_replace(lower(word), '^[.,;:!?()\[\]{}\"'']+', ''), '[.,;:!?()\[\]{}\"'']+$', '') AS bare FROM tk),
        tc AS (SELECT id, pos, word, bare, list_contains(['he', 'she', 'it', 'they', 'him', 'her', 'them', 'his', 'their', 'its'], bare) AS pro, list_filter(es, lambda e: bare <> '' AND (contains(lower(e), bare) OR contains(bare, lower(e))))[1] AS ent FROM tb),
        ty AS (SELECT *, ent IS NOT NULL AND lower(ent) <> bare AS fresh FROM tc),
        st AS (SELECT id, 0::BIGINT AS pos, [[]::VARCHAR[]] AS r, ''::VARCHAR AS shown FROM ws UNION ALL
            SELECT ty.id, ty.pos, [CASE WHEN pro AND len(st.r[1]) > 0 THEN st.r[1] WHEN fresh THEN list_concat([ent], list_filter(st.r[1], lambda x: x <> ent))[1:5] ELSE st.r[1] END],
                CASE WHEN pro AND len(st.r[1]) > 0 THEN word || ' [' || coalesce(CASE WHEN bare IN ('he', 'him', 'his') THEN list_filter(st.r[1], lambda e: regexp_matches(lower(e), 'mr|mrs|dr|prof'))[1] WHEN bare IN ('it', 'its') THEN list_filter(st.r[1], lambda e: NOT regexp_matches(lower(e), 'mr|mrs|person'))[1] END, st.r[1][1]) || ']' ELSE word END
            FROM st JOIN ty ON ty.id = st.id AND ty.pos = st.pos + 1),
        al AS (SELECT id, string_agg(shown, ' ' ORDER BY pos) FILTER (pos > 0) AS content FROM st GROUP BY id) SELECT id, coalesce(content, '') AS content FROM al""",
    "chunk_transcript": r"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(content, '[\s\p{Z}]+'), lambda x: x <> '') AS ws FROM store_documents),
        t AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
        s AS (SELECT id, word, pos, 1 AS chunk_no, length(word) AS held FROM t WHERE pos = 1 UNION ALL
            SELECT t.id, t.word, t.pos, CASE WHEN s.held >= 500 THEN s.chunk_no + 1 ELSE s.chunk_no END, CASE WHEN s.held >= 500 THEN length(t.word) ELSE s.held + 1 + length(t.word) END FROM s JOIN t ON t.id = s.id AND t.pos = s.pos + 1)
        SELECT id, chunk_no, md5(string_agg(word, ' ' ORDER BY pos)) AS chunk_md5 FROM s GROUP BY id, chunk_no""",
}
