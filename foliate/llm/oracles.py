"""Results of the queries that SQL can express, as DuckDB SQL."""

from .mixing import MAX_EPOCHS, WEIGHTS
from .neardup import RARE, THRESHOLD
from .topk import K, QUERY_EVERY, SCALE
from .url_filters import ALLOW_RULES, BLOCK_DOMAINS, BLOCK_RULES
from .warc import MIN_REVISIT_BYTES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for v, rules in (("allow", ALLOW_RULES), ("block", BLOCK_RULES)) for h, p in rules)
_DOMAINS = ", ".join(f"('{x}')" for x in BLOCK_DOMAINS)

MIXING = rf"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(concat(coalesce(CAST(doc_id AS VARCHAR), '-'), '/20250/', md5(coalesce(text, '')))) AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank, CAST(source_size AS DOUBLE) * {MAX_EPOCHS} AS cap FROM sums),
weighed AS (SELECT *, CAST(list_extract([{", ".join(map(str, WEIGHTS))}], CAST(rank % {len(WEIGHTS)} + 1 AS INTEGER)) AS DOUBLE) AS weight FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
final AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS f FROM levels),
targets AS (SELECT source, source_size, rank, CASE WHEN f IS NULL THEN cap ELSE least(cap, f * weight) END AS target FROM final),
queued AS (SELECT s.doc_id, s.size, s.h, t.source_size, t.rank, t.target, sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rounds AS (SELECT *, (r * source_size + cum) / target AS finish FROM queued, range({MAX_EPOCHS}) x(r) WHERE size > 0 AND target > 0),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, r, h, doc_id ROWS UNBOUNDED PRECEDING) AS served FROM rounds WHERE finish - size / target < 1),
taken AS (SELECT rank, h, doc_id, count(*) AS k FROM served WHERE served <= (SELECT sum(target) FROM targets) + 1e-6 GROUP BY 1, 2, 3)
SELECT q.doc_id, q.size, q.source_size, round(q.target, 6) AS target, CAST(coalesce(t.k, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.rank = t.rank AND q.h = t.h AND q.doc_id IS NOT DISTINCT FROM t.doc_id"""

ARCHIVES = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
n AS (SELECT page_id, octet_length(b) AS n, d, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to FROM n"""

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""

NEAR = rf"""WITH RECURSIVE words AS (SELECT doc_id, md5(text) AS d, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, d, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
df AS (SELECT g, 1 + ln(least(CAST((SELECT count(*) FROM documents) AS DOUBLE) / count(DISTINCT doc_id), {RARE})) / ln({RARE}) AS idf FROM grams GROUP BY g),
nodes AS (SELECT d, min(doc_id) AS rep FROM words GROUP BY d),
sets AS (SELECT grams.d, grams.g, count(*) * any_value(idf) AS weight FROM grams JOIN nodes ON grams.d = nodes.d AND grams.doc_id = nodes.rep JOIN df ON df.g = grams.g GROUP BY 1, 2),
totals AS (SELECT d, sum(weight) AS total FROM sets GROUP BY d),
pairs AS (SELECT a.d AS a, b.d AS b, sum(least(a.weight, b.weight)) AS inside FROM sets a JOIN sets b ON a.g = b.g AND a.d < b.d GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs JOIN totals ta ON ta.d = a JOIN totals tb ON tb.d = b WHERE inside / (ta.total + tb.total - inside) >= {THRESHOLD} - 1e-9),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT d AS a, d AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
classes AS (SELECT a AS d, min(rep) AS class_id FROM reach JOIN nodes ON nodes.d = b GROUP BY a)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM words JOIN classes USING (d)
UNION ALL SELECT doc_id, doc_id, true FROM documents WHERE text IS NULL"""

URLS = rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM u),
p AS (SELECT page_id, translate(host, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS i
  FROM p JOIN ({_RULES}) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(rv, CASE WHEN EXISTS (SELECT 1 FROM (VALUES {_DOMAINS}) x(d) WHERE host = d OR ends_with(host, '.' || d)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND i = 1"""

ORACLE_SQL = {"op1_fair_mixing": MIXING, "op5_arc_to_warc": ARCHIVES, "op7_threshold_topk": TOP_K, "op9_weighted_neardup": NEAR, "op10_url_cascade": URLS}
