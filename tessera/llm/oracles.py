"""SQL of the operators that SQL can express, for another engine on the same tables.

Each compares whole texts: window by window, and every pair that shares a shingle.
"""

from __future__ import annotations

from tessera.llm import mixing

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
  FROM d),
e AS (SELECT r, unnest(g) AS x FROM s),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.r = c.a JOIN s q ON q.r = c.b WHERE 5 * c.n >= 4 * (len(p.g) + len(q.g) - c.n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, t) AS (SELECT r, r FROM s UNION SELECT reach.r, u.b FROM reach JOIN u ON u.a = reach.t),
k AS (SELECT reach.r, min(s.doc_id) AS class_id FROM reach JOIN s ON s.r = reach.t GROUP BY reach.r),
m AS (SELECT a AS r, count(*) AS n FROM u GROUP BY a)
SELECT s.doc_id, k.class_id, coalesce(m.n, 0)::BIGINT AS n_links,
  CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY s.g) END AS copy_id
FROM s JOIN k ON k.r = s.r LEFT JOIN m ON m.r = s.r
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_ITEM_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT k FROM i),
x AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, z WHERE len(w) >= k)),
h AS (SELECT x.r, x.p, x.k, i.item FROM x JOIN i ON i.k = x.k AND i.s = x.s),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
o AS (SELECT r, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: length(x)) AS sizes,
  list_transform(regexp_split_to_array(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: length(x)) AS gaps FROM d JOIN (SELECT DISTINCT r FROM h) USING (r)),
y AS (SELECT r, q, q - row_number() OVER (PARTITION BY r ORDER BY q) AS island FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM h)),
-- Touching windows are one span.
v AS (SELECT r, min(q) AS a, max(q) AS b FROM y GROUP BY r, island),
e AS (SELECT r, string_agg((list_sum(gaps[1:a]) + coalesce(list_sum(sizes[1:a - 1]), 0))::BIGINT || '-' || (list_sum(gaps[1:b]) + list_sum(sizes[1:b]))::BIGINT, ',' ORDER BY a) AS spans FROM v JOIN o USING (r) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(e.spans, '') AS spans
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r LEFT JOIN e ON e.r = d.r
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT x.r, unnest(range(x.p, x.p + 35)) AS q FROM x JOIN again ON again.h = x.h)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.q) AS s, count(*) AS n FROM words LEFT JOIN gone ON gone.r = words.r AND gone.q = words.q WHERE gone.q IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""

ORACLES = {"op2_ngram_join": NGRAM_JOIN, "op4_mixing": mixing.oracle(), "op6_decontamination": DECONTAMINATION, "op7_substring_dedup": SUBSTRING_DEDUP}
