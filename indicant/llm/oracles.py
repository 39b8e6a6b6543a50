"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES, idf

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def license_sql() -> str:
    """Counts template words by (document, template, start) instead of probing positions."""
    weight = idf(TEMPLATES)
    rows = []
    for k, t in enumerate(TEMPLATES):
        at, size = t.key_at
        for j, w in enumerate(t.words):
            rows.append(f"({k}, '{t.label}', {t.base}, {size}, {sum(weight[x] for x in t.words)}, {j}, '{w}', {weight[w]}, {int(at <= j < at + size)})")
    return f"""
WITH tpl(t, label, base, key_size, total, j, w, weight, in_key) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
place AS (
  SELECT doc_id, t, label, base, p - j AS s, sum(weight)::DOUBLE / any_value(total)::DOUBLE AS score
  FROM tok JOIN tpl USING (w) GROUP BY doc_id, t, label, base, p - j
  HAVING sum(in_key) = any_value(key_size)),
agg AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, max(score) AS score
  FROM place GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN agg USING (doc_id)"""


DECONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i + 1 : i + least(10, len(ws))], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
cut AS (
  SELECT doc_id, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(greatest(0, len(ws) - k + 1))) AS i
        FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, k, i, item_id FROM cut JOIN win USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hit) GROUP BY doc_id),
of AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN of USING (doc_id)"""


NEAR_DEDUP_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i + 1 : i + 5], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.other, d.doc_id))::BIGINT AS component_id,
  d.doc_id <= coalesce(c.other, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: Sums run from the first component to the last, as doubles.
ANN_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM e),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    list_reduce(list_transform(range(1, len(x.v) + 1), lambda i: x.v[i] * q.v[i]), lambda a, b: a + b) / (x.n * q.n) AS score
  FROM n AS q JOIN n AS x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(x.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= 5"""

CHAT_SQL = r"""
WITH m AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 10 + 1)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k"""

#: Phrases as joined texts, cut from arrays of words, and judged against every longer one.
COLLOCATION_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWER} AS t FROM documents),
p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i + 1 : i + k], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM p, range(1, 6) AS r(k) WHERE len(ws) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT * FROM g WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM g AS b WHERE b.lang = g.lang AND b.k > g.k AND b.a >= g.a AND contains(' ' || b.phrase || ' ', ' ' || g.phrase || ' '))),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 :], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, n, j, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN g AS x ON x.lang = cut.lang AND x.phrase = head JOIN g AS y ON y.lang = cut.lang AND y.phrase = rest JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op3_near_dedup": NEAR_DEDUP_SQL, "op4_decontamination": DECONTAMINATION_SQL, "op5_ann": ANN_SQL, "op6_chat_format": CHAT_SQL, "op10_warc": WARC_SQL, "op11_collocations": COLLOCATION_SQL}
