"""SQL counterparts of the two exact deduplications."""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT r, doc_id, i, line, coalesce(keeper IS DISTINCT FROM doc_id AND keeper IS NOT NULL, false) AS dropped FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS h FROM s),
w AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, i, 1 AS again FROM h SEMI JOIN w USING (h)),
a AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d),
k AS (SELECT doc_id, i, word, coalesce(max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS removed FROM a LEFT JOIN c USING (doc_id, i)),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
