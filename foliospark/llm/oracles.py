"""DuckDB SQL that states operators' results over the driver's tables."""

ORACLES: dict[str, str] = {}

ORACLES["op1_secret_scan"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules(ord, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1)),
raw AS (
  SELECT doc_id, 0 AS ord, 'assign' AS kind, 6 AS least,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
    string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p FROM d
  UNION ALL SELECT doc_id, 1, 'access', 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', 24, regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0), string_split_regex(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 3, 'pem', 1, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0), string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM d
  UNION ALL SELECT doc_id, 4, 'jwt', 1, regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0), string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') FROM d),
hit AS (SELECT doc_id, ord, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM raw WHERE len(m) > 0),
span AS (
  SELECT doc_id, ord, kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n
  FROM hit WHERE length(g[i]) >= least),
said AS (SELECT doc_id, kind, ord, s, concat(kind, ':', s, ':', s + n) AS t FROM span),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(t, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(t, ',' ORDER BY s, ord) AS every
  FROM said GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS to_ FROM documents UNION SELECT node, b FROM reach JOIN way ON to_ = a),
c AS (SELECT node AS doc_id, min(to_) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

ORACLES["op2_exact_top_k"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

#: Texts are cut into overlapping stretches first, since substr walks from a text's start.
ORACLES["op8_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
o AS (SELECT r, x, unnest(range(0, length(x) // 2, 256)) AS o FROM d),
y AS (SELECT r, o, length(x) // 2 AS n, substr(x, 2 * o + 1, 2 * (256 + 400)) AS x FROM o),
p AS (SELECT r, o, n, x, o + unnest(range(0, least(256, n - o))) AS i FROM y),
w AS (SELECT r, i, substr(x, 2 * (i - o) + 1, 2) AS b, CASE WHEN i + 400 <= n THEN md5(substr(x, 2 * (i - o) + 1, 800)) END AS h FROM p),
c AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (SELECT w.r, w.i, w.b, max(CASE WHEN c.h IS NOT NULL THEN w.i END) OVER (PARTITION BY w.r ORDER BY w.i) AS last FROM w LEFT JOIN c USING (h)),
g AS (SELECT r, i, b, coalesce(last > i - 400, false) AS gone FROM m),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM g),
n AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM s GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN n USING (r)
"""

ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(t)) AS r FROM d),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM o),
w AS (SELECT r, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i+19], ' ') END AS x FROM p),
f AS (SELECT x, min((r, i)) AS first FROM w WHERE x IS NOT NULL GROUP BY x),
m AS (SELECT w.r, w.i, w.word, max(CASE WHEN f.first < (w.r, w.i) THEN w.i END) OVER (PARTITION BY w.r ORDER BY w.i) AS last FROM w LEFT JOIN f USING (x)),
n AS (SELECT r, count(*) FILTER (last > i - 20) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT coalesce(last > i - 20, false)), '') AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN n USING (r)
"""

ORACLES["quality_base"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
w AS (SELECT r, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i+7], ' ') END AS x FROM p),
m AS (SELECT r, i, max(CASE WHEN x IS NOT NULL AND again > 1 THEN i END) OVER (PARTITION BY r ORDER BY i) AS last FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS again FROM w)),
n AS (SELECT r, count(*) FILTER (last > i - 8) AS n FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(n.n, 0) > 30 * len(ws) AS base_failed
FROM d LEFT JOIN dup USING (r) LEFT JOIN n USING (r)
"""

#: The level at which all tokens are shared out, found by halving an interval: independent of the operator's closed form.
ORACLES["mixing_targets"] = r"""
WITH RECURSIVE d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT source, sum(n)::double AS size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS w FROM d GROUP BY source),
l AS (SELECT list(struct_pack(size := size, w := w)) AS ls, sum(size) AS whole, max(3 * size / w) AS most FROM s),
b AS (SELECT 0 AS k, 0.0::double AS lo, most AS hi, ls, whole FROM l
  UNION ALL SELECT k + 1, CASE WHEN v < whole THEN (lo + hi) / 2 ELSE lo END, CASE WHEN v < whole THEN hi ELSE (lo + hi) / 2 END, ls, whole
  FROM (SELECT *, list_sum(list_transform(ls, lambda x: least(3 * x.size, (lo + hi) / 2 * x.w))) AS v FROM b WHERE k < 100))
SELECT source, size::bigint AS source_size, round(least(3 * size, (SELECT hi FROM b WHERE k = 100) * w), 3) AS target FROM s
"""
