"""Line dedup as plain SQL, without fingerprints."""

# The scripts that put no spaces between words, and white space, as in line_dedup.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
SPACE = r"\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

LINE_DEDUP = rf"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS s,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM documents),
f AS (
  SELECT doc_id, i, trim(s) AS s, CASE WHEN strlen(trim(s)) >= 100 THEN 3
         ELSE len(regexp_extract_all(trim(s), '[{UNSPACED}]|[^{SPACE}{UNSPACED}]+')) END AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM l WHERE trim(s) <> ''),
p AS (
  SELECT *, lead(s) OVER d AS s2, lead(w) OVER d AS w2, lead(i) OVER d AS i2
  FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
win AS (
  SELECT doc_id, i AS a, i2 AS b, s || chr(10) || s2 AS h, w + w2 AS w FROM p WHERE s2 IS NOT NULL
  UNION ALL
  SELECT doc_id, i, i, s, w FROM f WHERE k = 1 OR k = n),
later AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) AS nth FROM win WHERE w >= 3)
  WHERE nth > 1),
gone AS (SELECT doc_id, a AS i FROM later UNION SELECT doc_id, b FROM later),
kept AS (
  SELECT l.doc_id, string_agg(s, chr(10) ORDER BY l.i) AS t
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
  WHERE g.i IS NULL GROUP BY l.doc_id),
counts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT c.doc_id, n_lines, n_removed,
       sha256(CASE WHEN n_removed > 0 AND trim(replace(coalesce(t, ''), chr(10), '')) = '' THEN ''
                   ELSE coalesce(t, '') END) AS text_sha256
FROM counts c LEFT JOIN kept k ON c.doc_id = k.doc_id
"""
