"""The same results as SQL for DuckDB, by query name."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
),
t AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM t
),
a AS (SELECT sum(s)::HUGEINT AS total FROM w),
-- A source is full if, with every source at its own rate or full earlier, the words still suffice.
f AS (
  SELECT x.source, x.s, x.w,
    4 * (sum(CASE WHEN y.s::HUGEINT * x.w <= x.s::HUGEINT * y.w THEN y.s ELSE 0 END)::HUGEINT * x.w
      + x.s::HUGEINT * sum(CASE WHEN y.s::HUGEINT * x.w <= x.s::HUGEINT * y.w THEN 0 ELSE y.w END)::HUGEINT)
      <= 3 * any_value(total) * x.w AS is_full
  FROM w x, w y, a GROUP BY x.source, x.s, x.w
),
l AS (
  SELECT 3 * any_value(total) - 4 * coalesce(sum(s) FILTER (is_full), 0)::HUGEINT AS rest,
    2 * coalesce(sum(w) FILTER (NOT is_full), 0)::HUGEINT AS open_weight
  FROM f, a
),
g AS (
  SELECT source, s, CASE WHEN is_full THEN (2 * s)::DOUBLE
    ELSE w::DOUBLE * rest::DOUBLE / open_weight::DOUBLE END AS target FROM f, l
),
r AS (
  SELECT d.doc_id, d.size, g.s AS source_size, g.target,
    CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5(concat_ws(':', '7', d.doc_id::VARCHAR, md5(coalesce(d.text, '')))), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP5 = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
h AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
m AS (
  SELECT h.page_id, h.host, h.path, r.verdict, r.rule_host || r.rule_path AS rule,
    row_number() OVER (PARTITION BY h.rowid_ ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM h) h LEFT JOIN rules r
    ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
s AS (SELECT row_id, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM s),
p AS (
  SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) x GROUP BY row_id, term
),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
w AS (
  SELECT c.term, floor(1000 * ln((2 * g.docs + 2) / (2 * c.df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term) c, g
),
m AS (SELECT s.row_id, s.doc_id, 100 - 90 + ((90 * s.n * g.docs) // g.length) AS m FROM s, g),
r AS (
  SELECT q.item_id, m.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN w ON w.term = q.term JOIN p ON p.term = q.term JOIN m ON m.row_id = p.row_id
  GROUP BY q.item_id, m.row_id, m.doc_id
),
t AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 10
"""


def all_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op5_url_filter": OP5, "op12_search": OP12}
