"""DuckDB SQL that gives the rows of operators whose results SQL can express."""

from __future__ import annotations

from .licenses import report_sql

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = f"translate({{0}}, '{UPPER}', '{UPPER.lower()}')"

JACCARD = f"""
WITH RECURSIVE
w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, b FROM reach JOIN both_ways ON r = a)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d
"""

_WORDS = "coalesce(regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
_GRAMS = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')})) AS x"
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(LOWER.format("text"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(LOWER.format("text"))} AS w FROM benchmark),
bn AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, x.g AS g FROM (SELECT item, n, {_GRAMS} FROM bn)),
lengths AS (SELECT DISTINCT n FROM grams),
windows AS (SELECT doc_id, n, x.i AS i, x.g AS g FROM (SELECT doc_id, n, {_GRAMS} FROM d CROSS JOIN lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item FROM windows JOIN grams USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(d, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT d, b FROM reach JOIN links ON r = a)
SELECT d AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, d = min(r) AS kept FROM reach LEFT JOIN n ON n.a = d GROUP BY d
"""

ORACLE_SQL = {"op1_license_scan": report_sql(), "op5_embedding_dedup": EMBEDDINGS, "op6_decontaminate": DECONTAMINATE, "op9_jaccard_join": JACCARD}
