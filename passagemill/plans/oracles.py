"""The catalogue's queries restated in SQL for an independent engine."""

from __future__ import annotations

from passagemill.settings import PROMPT_TEMPLATE

# Shared pieces ----------------------------------------------------------

BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_BLANK = BLANK.replace("[", "[^", 1)


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


FILES = r"""
named AS (
  SELECT doc_id, text, source, n_chars,
         ['.md', '.py', '.csv', '.png', '', '.LOG'][(doc_id % 6 + 1)::INT] AS ext0
  FROM documents),
files AS (
  SELECT doc_id, '/corpus/' || source || '/' || doc_id || '/' || file_name AS path, file_name,
         n_chars AS length, text, md5(text) AS hash,
         lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS file_type
  FROM (SELECT *, CASE WHEN ext0 = '' THEN 'README' WHEN doc_id % 11 = 0 THEN '.h' || ext0 ELSE 'f' || ext0 END AS file_name
        FROM named)),
kinds AS (
  SELECT *, CASE WHEN file_type IN ('.md', '.txt', '.rst', '.adoc') OR lower(file_name) IN ('readme', 'readme.md', 'readme.txt') THEN 'text'
                 WHEN file_type = '.py' THEN 'code' WHEN file_type IN ('.csv', '.tsv') THEN 'csv'
                 WHEN file_type = '.png' THEN 'image' ELSE 'other' END AS kind
  FROM files)"""

MANIFEST = FILES + r""",
manifest AS (
  SELECT path, CASE WHEN quality = 1 THEN hash ELSE md5('old' || text) END AS hash,
         '2026-01-01 00:00:00' AS processed_at, length AS size
  FROM files JOIN labels USING (doc_id)
  UNION ALL
  SELECT '/pages/' || page_id, md5(html), '2026-01-01 00:00:00', length(html)::BIGINT FROM pages)"""


def _windows(source: str, key: str, text: str, size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""
  SELECT d.*, i AS window_no, substr({text}, (i * {stride} + 1)::INT, {size}) AS piece
  FROM {source} d, LATERAL unnest(range(0, greatest(1, ceil((length({text}) - {overlap}) / {stride}.0)::BIGINT))) AS w(i)
  WHERE {text} <> ''"""


CHUNKS = f"""
chunks AS (
  SELECT doc_id::VARCHAR AS path, window_no::BIGINT AS chunk_no, md5(doc_id || '#' || window_no) AS chunk_id,
         piece AS content, '.' || lang AS file_type, 'd' || doc_id AS file_name, n_chars AS file_size
  FROM ({_windows('documents', 'doc_id', 'text', 1000, 200)}))"""


def _stripped_windows(source: str, key: str, text: str, size: int, overlap: int) -> str:
    """Windows of chunk_recursive with characters as the only separator."""
    return f"""
  SELECT *, (row_number() OVER (PARTITION BY {key} ORDER BY window_no) - 1)::BIGINT AS chunk_no
  FROM (SELECT * REPLACE ({_trim('piece')} AS piece) FROM ({_windows(source, key, text, size, overlap)}))
  WHERE piece <> ''"""


def _tf(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """Counts of hashed tokens, a row for each that is not zero."""
    return f"""
{name}_tf AS (
  SELECT key, dim, count(*) AS tf
  FROM (SELECT {key} AS key, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dim} AS dim
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {source}))
  GROUP BY key, dim)"""


def _counts(name: str, source: str, key: str, text: str) -> str:
    """Dense hashed token counts per row, as a list of 64 doubles."""
    return f"""{_tf(name, source, key, text)},
{name}_counts AS (
  SELECT k.{key} AS key, list(coalesce(tf, 0)::DOUBLE ORDER BY d.dim) AS counts
  FROM {source} k CROSS JOIN (SELECT unnest(range(64)) AS dim) d
  LEFT JOIN {name}_tf t ON t.key = k.{key} AND t.dim = d.dim
  GROUP BY k.{key}),
{name}_unit AS (
  SELECT key, list_transform(counts, lambda c: CASE WHEN n = 0 THEN 0 ELSE (c / n)::FLOAT END)::DOUBLE[] AS v
  FROM (SELECT key, counts, sqrt(list_sum(list_transform(counts, lambda c: c * c))) AS n FROM {name}_counts))"""


def _sum(values: str) -> str:
    """A left-to-right sum."""
    return f"list_reduce({values}, lambda s, x: s + x, 0.0::DOUBLE)"


def _dot(a: str, b: str) -> str:
    return _sum(f"list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])")


def _l2(a: str, b: str) -> str:
    return _sum(f"list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))")


def _norm(a: str) -> str:
    return f"sqrt({_sum(f'list_transform({a}, lambda e: e * e)')})"


CENTRES = """
flat AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
requests AS (
  SELECT q_id, list(x ORDER BY pos) AS q, q_id + 6 AS k, q_id * 3 + 18 AS fetch_k
  FROM (SELECT label::BIGINT AS q_id, pos, avg(x) AS x FROM flat GROUP BY label, pos) GROUP BY q_id),
store AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings)"""


def _knn(distance: str, limit: str = "k") -> str:
    return f"""
scored AS (SELECT q_id, k, fetch_k, chunk_id, q, v, {distance} AS distance FROM requests CROSS JOIN store),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance NULLS LAST, chunk_id)::BIGINT AS rank FROM scored),
near AS (SELECT * FROM ranked WHERE rank <= {limit})"""


def _cos0(a: str, b: str) -> str:
    return f"coalesce({_dot(a, b)} / nullif({_norm(a)} * {_norm(b)}, 0), 0)"


def _mmr(weight: str) -> str:
    """Needs ``near(q_id, k, chunk_id, rank, distance, q, v, weight)``."""
    return f"""
cand AS (SELECT q_id, k, chunk_id, rank, distance, v, {weight} AS w, {_cos0('v', 'q')} AS rel FROM near),
picks AS (
  SELECT q_id, 1 AS turn, [first(chunk_id ORDER BY rel DESC, rank)] AS ids, [first(v ORDER BY rel DESC, rank)] AS vecs
  FROM cand WHERE k > 0 GROUP BY q_id
  UNION ALL
  SELECT q_id, turn + 1, list_append(ids, first(chunk_id ORDER BY score DESC, rank)), list_append(vecs, first(v ORDER BY score DESC, rank))
  FROM (SELECT p.q_id, turn, ids, vecs, c.chunk_id, c.rank, c.v,
               w * rel - (1 - w) * list_max(list_transform(vecs, lambda u: {_cos0('c.v', 'u')})) AS score
        FROM picks p JOIN cand c ON c.q_id = p.q_id
        WHERE NOT list_contains(ids, c.chunk_id) AND turn < c.k)
  GROUP BY q_id, turn, ids, vecs),
longest AS (SELECT q_id, arg_max(ids, turn) AS ids FROM picks GROUP BY q_id),
picked AS (
  SELECT l.q_id, l.rank::BIGINT AS rank, l.chunk_id, c.distance
  FROM (SELECT q_id, generate_subscripts(ids, 1) AS rank, unnest(ids) AS chunk_id FROM longest) l
  JOIN cand c ON c.q_id = l.q_id AND c.chunk_id = l.chunk_id)"""


RANKED = "SELECT q_id, rank, chunk_id, round(distance, 6) AS distance FROM"

BODIES = r"""
bodies AS (
  SELECT item_id AS q_id, CASE item_id % 8
    WHEN 0 THEN to_json({'query': text})::VARCHAR
    WHEN 1 THEN to_json({'query': text, 'k': 5, 'search_type': 'mmr', 'fetch_k': 12, 'lambda_mult': 0.25})::VARCHAR
    WHEN 2 THEN to_json({'query': text, 'k': 20, 'search_type': 'similarity'})::VARCHAR
    WHEN 3 THEN to_json({'k': length(text)})::VARCHAR
    WHEN 4 THEN to_json({'query': ' ' || chr(10) || ' ', 'k': length(text)})::VARCHAR
    WHEN 5 THEN to_json({'query': ' ' || text || chr(10), 'k': 3, 'search_type': 'other'})::VARCHAR
    WHEN 6 THEN to_json({'query': text, 'k': '7'})::VARCHAR
    ELSE 'nope ' || text END AS body
  FROM benchmark),
parsed AS (SELECT q_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM bodies),
asked AS (
  SELECT q_id, json_extract_string(j, '$.query') AS raw,
         CASE WHEN json_type(j, '$.k') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(j, '$.k')::BIGINT END AS k0,
         json_extract_string(j, '$.search_type') AS type0,
         json_extract_string(j, '$.fetch_k')::BIGINT AS fetch0, json_extract_string(j, '$.lambda_mult')::DOUBLE AS lambda0
  FROM parsed),
checked AS (
  SELECT *, """ + _trim("raw") + r""" AS query FROM asked),
resolved AS (
  SELECT q_id, query, coalesce(k0, 15) AS k, CASE WHEN type0 = 'mmr' THEN 'mmr' ELSE 'similarity' END AS search_type,
         coalesce(fetch0, coalesce(k0, 15) * 3) AS fetch_k, coalesce(lambda0, 0.5)::DOUBLE AS lambda_mult
  FROM checked WHERE raw IS NOT NULL AND query <> '')"""

SEARCHED = f"""WITH RECURSIVE {BODIES}, {CHUNKS}, {_counts('d', 'chunks', 'chunk_id', 'content')},
{_counts('r', 'resolved', 'q_id', 'query')},
requests AS (
  SELECT q_id, CASE WHEN search_type = 'mmr' THEN fetch_k ELSE k END AS k, fetch_k, r_unit.v AS q
  FROM resolved JOIN r_unit ON r_unit.key = q_id),
store AS (SELECT key AS chunk_id, v FROM d_unit), {_knn(_l2('q', 'v'))},
diverse AS (
  SELECT near.* EXCLUDE (k), resolved.k, lambda_mult FROM near JOIN resolved USING (q_id) WHERE search_type = 'mmr'),
{_mmr('lambda_mult').replace('FROM near)', 'FROM diverse)')},
hits AS (
  SELECT q_id, rank, chunk_id, distance FROM near JOIN resolved USING (q_id) WHERE search_type = 'similarity'
  UNION ALL SELECT q_id, rank, chunk_id, distance FROM picked)
SELECT q_id, rank, chunk_id, content, path AS source, file_name, file_type, file_size, round(distance, 6) AS distance
FROM hits JOIN chunks USING (chunk_id)"""

QUESTIONS = f"""
questions AS (SELECT conv_id || ':' || turn AS q_id, text AS query FROM conversations WHERE role = 'user'), {CHUNKS},
{_counts('d', 'chunks', 'chunk_id', 'content')}, {_counts('r', 'questions', 'q_id', 'query')},
requests AS (SELECT key AS q_id, v AS q, 15 AS k, 45 AS fetch_k FROM r_unit),
store AS (SELECT key AS chunk_id, v FROM d_unit), {_knn(_l2('q', 'v'))},
hits AS (
  SELECT q_id, rank, chunk_id, content, path AS source, file_name, file_type, file_size, distance
  FROM near JOIN chunks USING (chunk_id))"""

PREVIEW = "CASE WHEN length({0}) > 200 THEN substr({0}, 1, 200) || '...' ELSE {0} END"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(context: str, question: str) -> str:
    before, rest = PROMPT_TEMPLATE.split("{question}")
    middle, after = rest.split("{context}")
    return f"{_literal(before)} || {question} || {_literal(middle)} || {context} || {_literal(after)}"


PROMPTS = f"""{QUESTIONS},
contexts AS (SELECT q_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY q_id),
prompts AS (
  SELECT q_id, query, {_prompt("coalesce(context, '')", "query")} AS prompt
  FROM questions LEFT JOIN contexts USING (q_id))"""

SOURCES = f"""
sources AS (
  SELECT q_id, string_agg(source || '|' || file_name || '|' || file_type || '|' || {PREVIEW.format('content')}, '#' ORDER BY rank) AS sources
  FROM hits GROUP BY q_id)"""

ECHO = """CASE WHEN length(prompt) % 2 = 1 THEN 'Error: odd prompt' ELSE length(prompt) || ' characters' END"""

CORPUS = r"""
corpus AS (
  SELECT doc_id, source || '/' || file_name AS path, file_name, text,
         lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS file_type, strlen(text) AS file_size
  FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'd' || doc_id || '.md' WHEN 1 THEN '_d' || doc_id || '.py' WHEN 2 THEN '.d' || doc_id || '.txt'
                       WHEN 3 THEN '.d' || doc_id WHEN 4 THEN 'd' || doc_id || '.LOG' ELSE 'd' || doc_id END AS file_name
        FROM documents)),
loaded AS (
  SELECT *, CASE WHEN file_type = '.py' THEN 'Source code file (.py):' || chr(10) || body ELSE body END AS content
  FROM (SELECT *, regexp_replace(text, '\r\n?', chr(10), 'g') AS body FROM corpus)
  WHERE (NOT starts_with(file_name, '.') OR file_name LIKE '%.md' OR file_name LIKE '%.txt')
    AND (file_type IN ('.md', '.py', '.txt') OR file_size < {cap}))"""

INGESTED = f"""WITH {CORPUS.replace('{cap}', '1048576')}, pieces AS ({_stripped_windows('loaded', 'path', 'content', 1000, 200)})
SELECT path, chunk_no, piece AS content, 64::BIGINT AS dimension, md5(text) AS hash, file_size::BIGINT AS size FROM pieces"""

CHANGED = "CASE WHEN quality = 0 THEN ' ' || chr(10) WHEN toxic = 1 THEN 'again ' || file_name ELSE text END"
CHANGED_CORPUS = CORPUS.replace("file_name, text,", f"file_name, {CHANGED} AS text,").replace("strlen(text)", f"strlen({CHANGED})") \
    .replace("FROM documents)", "FROM documents LEFT JOIN labels USING (doc_id) WHERE source <> 'src0')").replace("{cap}", "1048576")

FILE_COLUMNS = "c_custkey, c_name, c_nationkey, c_mktsegment"
CARD_ROW = (
    "'Row ' || row_no || ': c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey"
    " || ' | c_mktsegment: ' || c_mktsegment"
)


def _card(name: str, source: str, group: str) -> str:
    return f"""'CSV File: {name}' || chr(10) || 'Columns: {FILE_COLUMNS}' || chr(10) || 'Number of rows: ' || max(n) || chr(10)
       || chr(10) || 'Data preview:' || chr(10) || string_agg({CARD_ROW}, chr(10) ORDER BY row_no) FILTER (row_no <= 10)"""


def _sparse_search(dim: int) -> str:
    """Ten nearest chunks of each question by the cosine of hashed term counts."""
    return f"""WITH questions AS (SELECT conv_id || ':' || turn AS q_id, text AS query FROM conversations WHERE role = 'user'), {CHUNKS},
        {_tf('d', 'chunks', 'chunk_id', 'content', dim)}, {_tf('r', 'questions', 'q_id', 'query', dim)},
        products AS (
          SELECT r.key AS q_id, d.key AS chunk_id, sum(r.tf * d.tf)::DOUBLE AS product
          FROM r_tf r JOIN d_tf d USING (dim) GROUP BY r.key, d.key),
        d_len AS (SELECT key, sqrt(sum(tf * tf)::DOUBLE) AS n FROM d_tf GROUP BY key),
        r_len AS (SELECT key, sqrt(sum(tf * tf)::DOUBLE) AS n FROM r_tf GROUP BY key),
        scored AS (
          SELECT r.key AS q_id, d.key AS chunk_id, 1 - coalesce(product, 0) / (d.n * r.n) AS distance
          FROM r_len r CROSS JOIN d_len d LEFT JOIN products p ON p.q_id = r.key AND p.chunk_id = d.key)
        SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY distance, chunk_id)::BIGINT AS rank, chunk_id, round(distance, 6) AS distance
        FROM scored QUALIFY rank <= 10"""


ORACLES = {
    "file_kinds": f"""WITH {FILES} SELECT path, file_name, file_type, kind FROM kinds
        WHERE (NOT starts_with(file_name, '.') OR file_name LIKE '%.md' OR file_name LIKE '%.txt') AND (kind <> 'other' OR length < 1500)""",
    "content_hashes": "SELECT doc_id, md5(text) AS hash FROM documents",
    "change_status": f"""WITH {MANIFEST}
        SELECT coalesce(f.path, m.path) AS path,
               CASE WHEN m.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'missing' WHEN f.hash = m.hash THEN 'unchanged' ELSE 'changed' END AS status
        FROM files f FULL JOIN manifest m ON f.path = m.path""",
    "changed_files": f"""WITH {MANIFEST} SELECT path, hash FROM files f
        WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.path = f.path AND m.hash = f.hash)""",
    "manifest_merge": f"""WITH {MANIFEST}
        SELECT coalesce(f.path, m.path) AS path, coalesce(f.hash, m.hash) AS hash,
               CASE WHEN f.path IS NULL THEN m.processed_at ELSE '2026-02-01 00:00:00' END AS processed_at, coalesce(f.length + 1, m.size) AS size
        FROM files f FULL JOIN manifest m ON f.path = m.path""",
    "wrapped_documents": f"""WITH {FILES}, wrapped AS (
        SELECT *, CASE kind WHEN 'code' THEN 'Source code file (' || file_type || '):' || chr(10) || text
            WHEN 'image' THEN 'OCR extracted text from image:' || chr(10) || {_trim('text')} ELSE text END AS content FROM kinds)
        SELECT path, file_name, file_type, length AS file_size, content, '2026-01-01 00:00:00' AS processed_at, hash
        FROM wrapped WHERE regexp_matches(content, '{NON_BLANK}')""",
    "row_text": """SELECT c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'nan')
        || ' | c_nationkey: ' || c_nationkey || ' | c_mktsegment: ' || c_mktsegment AS line FROM customer""",
    "table_card": f"""SELECT 'customer.csv' AS name, {_card('customer.csv', 'customer', '')} AS content
        FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row_no, count(*) OVER () AS n FROM customer)""",
    "decode_text": "SELECT doc_id, text AS content FROM documents",
    "scan_files": f"""WITH {CORPUS.replace('{cap}', '1')}
        SELECT path, file_size::BIGINT AS length, text AS content, md5(text) AS hash FROM corpus""",
    "scan_csv": """SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment,
        (c_custkey // 500)::VARCHAR AS folder FROM customer""",
    "csv_cards": f"""SELECT block, {_card('part', 'customer', 'block')} AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY c_custkey) AS row_no, count(*) OVER (PARTITION BY block) AS n
              FROM (SELECT *, c_custkey // 500 AS block FROM customer)) GROUP BY block""",
    "load_documents": f"""WITH {CORPUS.replace('{cap}', '4000')}
        SELECT path, file_name, file_type, file_size::BIGINT AS file_size, content, md5(text) AS hash FROM loaded
        WHERE regexp_matches(content, '{NON_BLANK}')""",
    "ingest": INGESTED,
    "rebuild": INGESTED,
    "ingest_changes": f"""WITH {CHANGED_CORPUS}, pieces AS ({_stripped_windows('loaded', 'path', 'content', 1000, 200)})
        SELECT file_name, chunk_no, piece AS content FROM pieces""",
    "chunk_fixed": f"WITH {CHUNKS} SELECT path, chunk_no, chunk_id, content, file_type FROM chunks",
    "chunk_windows": f"""SELECT doc_id::VARCHAR AS path, chunk_no, md5(doc_id || '#' || chunk_no) AS chunk_id, piece AS content
        FROM ({_stripped_windows('documents', 'doc_id', 'text', 700, 300)})""",
    "embed_hash": f"""WITH {_counts('d', 'documents', 'doc_id', 'text')} SELECT key AS doc_id, dim, tf FROM d_tf""",
    "embed_hash_unit": f"""WITH {_counts('d', 'documents', 'doc_id', 'text')}
        SELECT key AS doc_id, array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), ',') AS vector FROM d_unit""",
    "embed_user": """SELECT doc_id, length(text)::DOUBLE AS characters,
        length(regexp_replace(text, '[^aeiou]', '', 'g'))::DOUBLE AS vowels FROM documents""",
    "vector_functions": f"""WITH {CENTRES}, pairs AS (
        SELECT vec_id, embedding::DOUBLE[] AS a, q AS b FROM embeddings JOIN requests ON q_id = label)
        SELECT vec_id, round({_l2('a', 'b')}, 6) AS l2, round({_dot('a', 'b')}, 6) AS dot, round({_norm('b')}, 6) AS norm,
               round({_dot('a', 'b')} / ({_norm('a')} * {_norm('b')}), 6) AS cosine, round(b[1] / {_norm('b')}, 6) AS first_of_unit FROM pairs""",
    "knn_single": f"""WITH {CENTRES}, centre AS (
        SELECT list(x ORDER BY pos) AS q FROM (SELECT pos, avg(x) AS x FROM flat GROUP BY pos))
        SELECT row_number() OVER (ORDER BY d, chunk_id)::BIGINT AS rank, chunk_id, round(d, 6) AS distance
        FROM (SELECT chunk_id, {_l2('v', 'q')} AS d FROM store CROSS JOIN centre) QUALIFY rank <= 15""",
    "knn_batch_l2": f"WITH {CENTRES}, {_knn(_l2('q', 'v'))} {RANKED} near",
    "knn_batch_cosine": f"WITH {CENTRES}, {_knn('1 - ' + _dot('q', 'v') + ' / (' + _norm('q') + ' * ' + _norm('v') + ')')} {RANKED} near",
    "knn_batch_dot": f"WITH {CENTRES}, {_knn('-' + _dot('q', 'v'))} {RANKED} near",
    "knn_batch_grid": f"WITH {CENTRES}, {_knn(_l2('q', 'v'))} {RANKED} near",
    "knn_cells_l2": f"WITH {CENTRES}, {_knn(_l2('q', 'v'))} {RANKED} near",
    "knn_cells_cosine": f"WITH {CENTRES}, {_knn('1 - ' + _dot('q', 'v') + ' / (' + _norm('q') + ' * ' + _norm('v') + ')')} {RANKED} near",
    "mmr": f"WITH RECURSIVE {CENTRES}, {_knn(_l2('q', 'v'), 'fetch_k')}, {_mmr('0.5')} {RANKED} picked",
    "mmr_rounds": f"WITH RECURSIVE {CENTRES}, {_knn(_l2('q', 'v'), 'fetch_k')}, {_mmr('0.5')} {RANKED} picked",
    "mmr_lambda_1": f"""WITH {CENTRES}, {_knn(_l2('q', 'v'), 'fetch_k')},
        again AS (SELECT q_id, k, chunk_id, distance, row_number() OVER (PARTITION BY q_id ORDER BY {_cos0('v', 'q')} DESC, rank)::BIGINT AS rank FROM near)
        {RANKED} again WHERE rank <= k""",
    "requests_valid": f"WITH {BODIES} SELECT * FROM resolved",
    "requests_rejected": f"""WITH {BODIES} SELECT q_id, CASE WHEN raw IS NULL THEN 'missing query' ELSE 'empty query' END AS reason
        FROM checked WHERE raw IS NULL OR query = ''""",
    "read_questions": f"""SELECT conv_id || ':' || turn AS q_id, {_trim('text')} AS query FROM conversations
        WHERE role = 'user' AND regexp_matches(text, '{NON_BLANK}')""",
    "chunk_recursive_cover": """SELECT doc_id::VARCHAR AS path, md5(regexp_replace(text, '\\s', '', 'g')) AS solid, true AS all_fit, true AS from_zero,
          true AS gapless, 0::BIGINT AS untrimmed FROM documents WHERE regexp_matches(text, '\\S')""",
    "word2vec_cover": """WITH words AS (
          SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents),
        known AS (SELECT word FROM words GROUP BY word HAVING count(*) >= 5),
        counted AS (SELECT doc_id, count(*) AS n_words, count(k.word) AS n_known FROM words w LEFT JOIN known k USING (word) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_known, 0) AS n_known, 16::BIGINT AS dimension, coalesce(n_known, 0) > 0 AS has_vector
        FROM documents LEFT JOIN counted USING (doc_id)""",
    "sparse_search": _sparse_search(64),
    "term_index": _sparse_search(64),
    "term_index_wide": _sparse_search(1 << 18),
    "question_hits": f"WITH {QUESTIONS} SELECT * REPLACE (round(distance, 6) AS distance) FROM hits",
    "hit_counts": f"WITH {QUESTIONS} SELECT q_id, count(distance) AS hits FROM questions LEFT JOIN hits USING (q_id) GROUP BY q_id",
    "files_fetched": f"WITH {QUESTIONS} SELECT q_id, string_agg(file_name, ',' ORDER BY rank) AS file_names FROM hits GROUP BY q_id",
    "stuffed_context": f"WITH {QUESTIONS} SELECT q_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY q_id",
    "prompts": f"WITH {PROMPTS} SELECT q_id, query, prompt FROM prompts",
    "source_previews": f"WITH {QUESTIONS}, {SOURCES} SELECT q_id, sources FROM sources",
    "hits_json": f"""WITH {QUESTIONS}, results AS (
        SELECT q_id, count(*) AS n, string_agg(source || '|' || file_name || '|' || file_type || '|' || file_size || '|' || content, '#' ORDER BY rank) AS results
        FROM hits GROUP BY q_id) SELECT q_id, query, coalesce(n, 0) AS count, coalesce(results, '') AS results FROM questions LEFT JOIN results USING (q_id)""",
    "answers_echo": f"WITH {PROMPTS} SELECT q_id, query, {ECHO} AS answer, length(prompt) % 2 = 0 AS answered FROM prompts",
    "stream_replies": f"""WITH {BODIES}
        SELECT q_id, CASE WHEN raw IS NULL OR query = '' THEN 'rejected' ELSE 'answered' END AS status,
               CASE WHEN raw IS NULL THEN 'missing query' WHEN query = '' THEN 'empty query' END AS reason,
               CASE WHEN raw IS NOT NULL AND query <> '' THEN least(k, CASE WHEN type0 = 'mmr' THEN fetch_k ELSE k END) END::BIGINT AS hits
        FROM (SELECT *, coalesce(k0, 15) AS k, coalesce(fetch0, coalesce(k0, 15) * 3) AS fetch_k FROM checked)""",
    "answer_records": f"""WITH {PROMPTS}, {SOURCES}
        SELECT q_id, query, {ECHO} AS answer, CASE WHEN length(prompt) % 2 = 0 THEN coalesce(sources, '') ELSE '' END AS sources
        FROM prompts LEFT JOIN sources USING (q_id)""",
    "answer_questions": f"""WITH {PROMPTS}, {SOURCES}
        SELECT q_id, query, {ECHO} AS answer, CASE WHEN length(prompt) % 2 = 0 THEN coalesce(sources, '') ELSE '' END AS sources
        FROM prompts LEFT JOIN sources USING (q_id)""",
    "search": SEARCHED,
    "store_info": """SELECT '.' || label AS file_type, count(embedding) AS vectors, count(DISTINCT label) AS documents, max(len(embedding))::INT AS dimension
        FROM embeddings GROUP BY label""",
    "ingest_counts": f"""WITH {CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents_loaded, (SELECT count(*) FROM chunks) AS chunks_created""",
    "replace_chunks": f"""WITH {CHUNKS}, changed AS (SELECT d.* FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0)
        SELECT path, chunk_no, content FROM chunks WHERE path NOT IN (SELECT doc_id::VARCHAR FROM changed)
        UNION ALL SELECT doc_id::VARCHAR, window_no::BIGINT, piece FROM ({_windows('changed', 'doc_id', 'text', 500, 100)})""",
    "extract_text_user": f"""WITH {FILES} SELECT path, CASE WHEN text LIKE 'E%' THEN '' ELSE replace(text, ' ', '_') END AS content FROM kinds WHERE kind = 'image'""",
    "manifest_roundtrip": f"WITH {MANIFEST} SELECT path, hash, processed_at, size + 1 AS size FROM manifest",
    "store_roundtrip": f"WITH {CHUNKS} SELECT path, chunk_no, chunk_id, content, file_size, 64::BIGINT AS dimension FROM chunks",
    "compact_store": f"""WITH {CHUNKS}
        SELECT path, chunk_no, content FROM chunks WHERE path NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 0 OR toxic = 1)
        UNION ALL SELECT doc_id::VARCHAR, 0::BIGINT, 'seen as .' || lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 0""",
    "store_status": "SELECT count(*) > 0 AS store_exists, count(*) > 0 AS store_loaded, false AS manifest_exists, true AS folder_exists FROM documents",
    "ingest_stream": f"""SELECT doc_id::VARCHAR AS path, chunk_no, md5(doc_id || '#' || chunk_no) AS chunk_id, piece AS content
        FROM ({_stripped_windows('documents', 'doc_id', 'text', 1000, 200)})""",
    "search_stream": SEARCHED,
    "content_previews": f"SELECT doc_id, {PREVIEW.format('text')} AS preview FROM documents",
    "rendered_prompt": f"SELECT doc_id, {_prompt('text', 'source')} AS prompt FROM documents",
}
