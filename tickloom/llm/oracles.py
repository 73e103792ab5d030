"""SQL for the queries that SQL can express, in the checking engine's spelling."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Bytes are looked at as pairs of hex digits.
SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
 SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w
 FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS p FROM docs WHERE length(h) >= 200)),
again AS (
 SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM win)
 WHERE r > 1),
islands AS (
 SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS starts
  FROM again)),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM islands GROUP BY doc_id, no),
gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs),
cut AS (
 SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last_e,
  string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept
 FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
 coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_e, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

WINDOW_DEDUP = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
 SELECT doc_id, p, array_to_string(w[p + 1:p + 50], ' ') AS t
 FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM docs WHERE len(w) >= 50)),
again AS (
 SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY t) AS first FROM win) WHERE first < doc_id),
islands AS (
 SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS starts
  FROM again)),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM islands GROUP BY doc_id, no),
gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(e - s) AS n_removed, max(e) AS last_e FROM runs GROUP BY doc_id),
kept AS (
 SELECT doc_id, string_agg(array_to_string(part, ' '), ' ' ORDER BY s) AS kept FROM (
  SELECT doc_id, s, w[before + 1:s] AS part FROM gaps JOIN docs USING (doc_id)
  UNION ALL SELECT doc_id, len(w), w[coalesce(last_e, 0) + 1:len(w)] FROM docs LEFT JOIN cut USING (doc_id))
 WHERE len(part) > 0 GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = f"""
WITH RECURSIVE docs AS (
 SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w
 FROM documents),
sets AS MATERIALIZED (
 SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 4], ' ') AS t
 FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS p FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
 SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y
  ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL)
 JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * shared >= 80 * (m.n + n.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
 SELECT a AS node, b AS seen FROM ways
 UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.seen),
least AS (SELECT node, min(seen) AS seen FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(coalesce(l.seen, d.doc_id), d.doc_id) AS component_id,
 coalesce(l.seen, d.doc_id) >= d.doc_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.node = d.doc_id"""


#: CRC-32, bit by bit.
_CRC32 = """list_reduce(flatten([[(ascii(c) >> b) & 1 for b in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')]),
 lambda r, b: xor(r >> 1, CASE WHEN xor(r, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295)"""

#: Every stretch that keeps a period, by the pairs of equal words at that distance.
PERIODIC_RUNS = f"""
WITH plain AS (SELECT doc_id, {WORDS} AS w, xor({_CRC32}, 4294967295) AS h FROM documents),
tails AS (SELECT *, len(w) AS n, h // 10 AS g FROM plain),
moved AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM tails),
docs AS (
 SELECT doc_id, n, [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] for i in range(n)] AS w
 FROM moved),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
pairs AS (
 SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
 ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
 SELECT doc_id, q, min(i) AS s, count(*) + q AS size FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
 GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, size, min(q) AS q FROM stretches GROUP BY doc_id, s, size),
best AS (
 SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'size': size, 'q': q}}, [-size, s, q]) AS top,
  string_agg(concat_ws(',', s, size, q) || chr(10), '' ORDER BY s, q) AS listed
 FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (
 SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.size AS length, top.q AS period,
 1000 * top.size // top.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
 sha256(coalesce(kept, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

HARD_NEGATIVES = """
WITH rows AS MATERIALIZED (
 SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
 SELECT a.id AS anchor, r.id, a.label = r.label AS same,
  CAST(list_sum([a.v[k] * r.v[k] for k in range(1, len(a.v) + 1)]) AS BIGINT) AS score
 FROM rows a JOIN rows r ON a.id % 50 = 0 AND a.id <> r.id),
positives AS (
 SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
 CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
 n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
 SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  '{_UPPER}', '{_LOWER}') AS key
 FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM docs)),
shared AS (
 SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND last <> doc_id) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key) GROUP BY doc_id"""
