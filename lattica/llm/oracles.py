"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([w[i:i + 3] FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, array_to_string(unnest(s), ' ') AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT a AS doc_id, b AS r FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(min(r), doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(min(r), doc_id)) AS kept
FROM sizes LEFT JOIN reach USING (doc_id) GROUP BY doc_id, n
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS x
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM d, lengths, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m
), found AS (SELECT doc_id, item_id, i, m FROM places JOIN windows USING (m, x)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12 = """
WITH closed AS (SELECT sale_id, min(shipped_at) AS shipped FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id),
homes AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
timed AS (
  SELECT coalesce(h.nation_id, -1) AS nation_id, CAST(floor(epoch(s.sold_at)) AS BIGINT) AS b, CAST(floor(epoch(c.shipped)) AS BIGINT) + 86400 AS e,
         coalesce(CAST(floor(100 * s.total + 0.5) AS BIGINT), 0) AS cents
  FROM sales s LEFT JOIN closed c ON s.sale_id = c.sale_id LEFT JOIN homes h ON s.client_id = h.client_id
), kept AS (SELECT * FROM timed WHERE b IS NOT NULL AND (e IS NULL OR e > b)),
counted AS (SELECT nation_id, b, e, cents FROM kept UNION ALL SELECT -2, b, e, cents FROM kept),
changes AS (
  SELECT nation_id, t, sum(n) AS n, sum(c) AS c
  FROM (SELECT nation_id, b AS t, 1 AS n, cents AS c FROM counted UNION ALL SELECT nation_id, e, -1, -cents FROM counted WHERE e IS NOT NULL)
  GROUP BY nation_id, t HAVING sum(n) <> 0 OR sum(c) <> 0
), swept AS (
  SELECT nation_id, t, lead(t) OVER w AS u, sum(n) OVER w AS n_open, sum(c) OVER w AS open_cents FROM changes WINDOW w AS (PARTITION BY nation_id ORDER BY t)
)
SELECT CAST(nation_id AS INTEGER) AS nation_id, t AS from_s, u AS to_s, CAST(n_open AS BIGINT) AS n_open, CAST(open_cents AS BIGINT) AS open_cents,
       CAST(max(n_open) OVER (PARTITION BY nation_id ORDER BY t) AS BIGINT) AS high_open, open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
FROM swept
"""

OP13 = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS earliest FROM texts
), masks AS (
  SELECT doc_id, part,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(earliest < doc_id, false)::INT AS m
  FROM measured
), known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, m),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, bit)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS prior FROM orders, range(1, 6) AS r(s)),
found AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (m & bit = 0 AND m & prior = 0), 0) AS kept, coalesce(sum(n) FILTER (m & bit <> 0 AND m & prior = 0), 0) AS removed,
         coalesce(sum(n) FILTER (m & bit <> 0 AND m & prior <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (m & bit <> 0 AND m & prior = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (m & bit <> 0 AND m & prior = 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
