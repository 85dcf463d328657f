"""The queries' results as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..vocab import MODELS

WORD = r"'(^|[^a-z0-9à-öø-ÿß])({0})([^a-z0-9à-öø-ÿß]|$)'"
#: The surface forms whose stem is that of `air`, and of `flight`.
AIR, FLIGHT = "air|airs|aired|airing|aire|aires|airings", "flight|flights|flighted|flighting"


def _match(column: str, forms: str) -> str:
    return f"regexp_matches(lower({column}), {WORD.format(forms)})"


Q1 = f"""SELECT DISTINCT doc_id FROM documents WHERE {_match("text", AIR)}
   OR len(list_filter(string_split(text, chr(10)), lambda l: {_match("l", AIR)})) > 0"""

#: Trigrams of a text in order, as a list; and the different ones.
GRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
ORDERED = GRAMS.replace("list_distinct(", "(", 1)

NAMES = "names AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name)"

#: Similarity of each text to each word, to any part of it and to whole words of it.
Q2 = f"""WITH {NAMES},
q AS (SELECT word, {GRAMS.format("word")} AS q FROM (VALUES ('gizmoo'), ('smal'), ('widgt'), ('economxy')) w(word)),
texts AS (SELECT id, p_name AS text, true AS own FROM names
   UNION SELECT id, concat_ws(' ', p_type, p_brand), false FROM part JOIN names USING (p_name)),
g AS (SELECT id, word, text, own, q, {ORDERED.format("text")} AS o,
   flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_concat([1], list_transform(range(1, length(w) + 1), lambda i: 0)))) AS begins
   FROM (SELECT DISTINCT text FROM texts) t JOIN texts USING (text), q),
d AS (SELECT DISTINCT word, text, q, o, begins FROM g),
p AS (SELECT *, unnest(range(1, len(o) + 1)) AS s FROM d),
e AS (SELECT *, unnest(range(s, len(o) + 1)) AS e FROM p),
x AS (SELECT word, text, list_distinct(o[s:e]) AS part, q, begins[s] = 1 AND (e = len(o) OR begins[e + 1] = 1) AS whole FROM e),
y AS (SELECT word, text, whole, len(list_intersect(part, q)) / (len(part) + len(q) - len(list_intersect(part, q))) AS score FROM x),
z AS (SELECT word, text, max(score) AS score, max(score) FILTER (whole) AS strict FROM y GROUP BY word, text),
best AS (SELECT id, word, max(score) AS score FROM texts JOIN z USING (text)
   WHERE (own AND CAST(score AS FLOAT) >= CAST(0.6 AS FLOAT)) OR (NOT own AND CAST(strict AS FLOAT) >= CAST(0.5 AS FLOAT)) GROUP BY id, word)
SELECT id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 5) AS score, p_name AS full_text, 0.6::DOUBLE AS similarity_threshold, word AS searched, 'word_similarity' AS method
FROM best JOIN names USING (id)"""

PAIRS = f"""{NAMES}, g AS (SELECT id, lower(p_name) AS p_name, {GRAMS.format("p_name")} AS g FROM names),
pairs AS (SELECT a.id AS a, b.id AS b, a.p_name AS name_a, b.p_name AS name_b,
   len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s
   FROM g a JOIN g b ON a.id < b.id)"""

EDGES = """edges AS (SELECT 'cn' || c_custkey AS id, 'c' || c_custkey AS s, 'n' || c_nationkey AS t FROM customer
   UNION ALL SELECT 'sn' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey FROM supplier
   UNION ALL SELECT 'nr' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""

_MODELS = ", ".join(f"({number}, '{name}')" for name, number in MODELS.items())
#: Files, the models that they were given to, and a row for each of both.
FILES = "SELECT event_id AS file_id, ts AS processed_at FROM events"
BRIDGE = "SELECT file_id, model_id FROM (SELECT event_id AS file_id, unnest(list_distinct([user_id % 8 + 1, event_id % 3 + 1])) AS model_id FROM events) WHERE model_id IS NOT NULL"
MORE_FILES = "SELECT -1 - i, TIMESTAMP '2026-10-10 12:00:00' FROM range(10) t(i)"
MORE_LINKS = "SELECT -1 - i % 10, i % 7 + 1 FROM range(21) t(i)"
DAILY = """WITH files AS ({files}), bridge AS ({bridge}), models(model_id, model_name) AS (VALUES {models})
SELECT CAST(processed_at AS DATE) AS processing_date, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models, {count}
FROM files JOIN bridge USING (file_id) JOIN models USING (model_id) WHERE processed_at IS NOT NULL GROUP BY 1"""

EMAIL = """CASE WHEN doc_id % 7 = 0 THEN '{"subject":' WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '{"subject":"s","from":"f"}'
   WHEN doc_id % 5 = 0 THEN '{"subject":"re: Redacted","from":"a","to":"b"}' WHEN doc_id % 11 = 0 THEN '{"subject":"s","from":"a____b","to":"c"}'
   WHEN doc_id % 17 = 0 THEN '["subject","from","to"]' WHEN doc_id % 19 = 0 THEN '{"subject":"a_b","from":null,"to":"c"}'
   ELSE '{"subject":"' || lang || '","from":"' || source || '","to":"n' || doc_id || '"}' END"""
Q6 = f"""WITH mails AS (SELECT doc_id, {EMAIL} AS email_fields FROM documents),
parsed AS (SELECT *, CASE WHEN json_valid(email_fields) THEN CAST(email_fields AS JSON) END AS j FROM mails)
SELECT doc_id, email_fields FROM parsed WHERE j IS NOT NULL AND """ + " AND ".join(rf"(j ->> '{k}') NOT ILIKE '%REDACTED%' AND (j ->> '{k}') NOT ILIKE '%\_\_\_\_%' ESCAPE '\'" for k in ("subject", "from", "to"))
EVENTS_JSON = r"SELECT event_id, props FROM events WHERE props ->> 'k' NOT ILIKE '%7%' AND props ->> 'k' NOT ILIKE '%\_\_\_\_%' ESCAPE '\'"


def _profile(table: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        text, number = kind == "text", kind == "number"
        parts.append(
            f"SELECT '{name}' AS column_name, count(*) AS rows, count(*) - count({name}) AS null_count, "
            + (f"count(*) FILTER ({name} = '') AS empty_count, max(length({name})) AS max_chars, " if text else "NULL::BIGINT AS empty_count, NULL::BIGINT AS max_chars, ")
            + (f"CAST(min({name}) AS DOUBLE) + 0.0 AS min_value, CAST(max({name}) AS DOUBLE) + 0.0 AS max_value" if number else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value")
            + f" FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _categories(table: str, column: str) -> str:
    return f"""WITH c AS (SELECT {column} AS label, count(*) AS n FROM {table} GROUP BY 1)
SELECT label, n, (SELECT count(*) FROM c) AS distinct_count FROM c ORDER BY n DESC, label NULLS FIRST LIMIT 30"""


def _references(child: str, column: str, parent: str, key: str, keep: str) -> str:
    return f"""WITH p AS (SELECT DISTINCT {key} AS k FROM {parent} WHERE {keep}), c AS (SELECT {column} AS r FROM {child} WHERE {column} IS NOT NULL),
m AS (SELECT r FROM c WHERE r NOT IN (SELECT k FROM p WHERE k IS NOT NULL))
SELECT (SELECT count(*) FROM c) AS nonnull_rows, (SELECT count(*) FROM m) AS unmatched_rows, (SELECT count(DISTINCT r) FROM m) AS unmatched_values"""


def _place(name: str) -> str:
    """A table's rows with their place in the file. The views over the tables keep the file's order."""
    return f"(SELECT *, row_number() OVER () - 1 AS file_row_number FROM {name})"


LINES = f"""rows AS (SELECT *, l_partkey IS NOT NULL AND l_quantity < 50 AS sound FROM {_place("lineitem")}),
ranked AS (SELECT *, row_number() OVER w AS i,
   first_value(hash(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) OVER w
   = hash(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS same
   FROM rows WHERE sound WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY file_row_number)),
classified AS (SELECT l_orderkey, l_linenumber, l_partkey, file_row_number, CASE WHEN i = 1 THEN 'accepted' WHEN same THEN 'duplicate' ELSE 'quarantined' END AS status,
   CASE WHEN i > 1 AND NOT same THEN 'Conflicting unique key' END AS reason FROM ranked
   UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, file_row_number, 'quarantined', CASE WHEN l_partkey IS NULL THEN 'null value in l_partkey' ELSE 'quantity below 50' END FROM rows WHERE NOT sound)"""

NOTATION = """CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
   WHEN 2 THEN strftime(o_orderdate, '%-m.%-d.%Y') WHEN 3 THEN strftime(o_orderdate, '%m%d%Y') WHEN 4 THEN strftime(o_orderdate, '%B %-d, %Y')
   WHEN 5 THEN strftime(o_orderdate, '%d %b %Y') WHEN 6 THEN strftime(o_orderdate, '%Y') WHEN 7 THEN strftime(o_orderdate, '%b %Y') ELSE '13/13/2000' END"""

_NUMBER = {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"}
_ORDERS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "other", "o_orderpriority": "text"}
_LINES = {"l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "other"}

ORACLE_SQL = {
    "q1_fulltext": Q1,
    "q1_fingerprint": f"SELECT sha256(string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id)) AS fingerprint, count(*) AS n FROM ({Q1})",
    "c1_fulltext_lines": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE {_match("line", AIR)}""",
    "c1_fulltext_flight": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE {_match("line", FLIGHT)}""",
    "c1_sample_documents": """WITH labels AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT coalesce(source, 'gemini') AS label FROM documents))
SELECT doc_id, label AS source, CAST(id AS INTEGER) AS source_id FROM (SELECT doc_id, coalesce(source, 'gemini') AS label FROM documents ORDER BY doc_id LIMIT 100) JOIN labels USING (label)""",
    "c1_substring": "SELECT doc_id, source FROM documents WHERE text ILIKE '%air%'",
    "c1_sample_semi": "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100)",
    "text_vector_cutoff": "SELECT item_id, octet_length(encode(text)) > 400 AS too_large, octet_length(encode(text)) <= 400 AS has_vector FROM benchmark",
    "q2_fuzzy_words": Q2,
    "name_similarity": f"WITH {PAIRS} SELECT name_a, name_b, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 5) AS similarity FROM pairs WHERE s >= 0.5",
    "q3_two_hop": f"""WITH {EDGES} SELECT a.s AS start_node_id, a.id AS first_edge_id, a.t AS middle_node_id, b.id AS second_edge_id, b.t AS end_node_id
FROM edges a JOIN edges b ON a.t = b.s WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.t = a.s) AND NOT EXISTS (SELECT 1 FROM edges y WHERE y.s = b.t)""",
    "q4_entity_groups": f"""WITH RECURSIVE sums AS (SELECT p_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IS NOT NULL GROUP BY 1 HAVING total > 0),
items AS (SELECT row_number() OVER (ORDER BY p_name) AS id, *, {GRAMS.format("p_name")} AS g FROM sums),
edges AS (SELECT a.id AS s, b.id AS t FROM items a JOIN items b ON a.id <> b.id AND len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.5),
reach AS (SELECT id AS node, id AS grp FROM items UNION SELECT e.t, r.grp FROM reach r JOIN edges e ON e.s = r.node),
groups AS (SELECT node, min(grp) AS grp FROM reach GROUP BY node)
SELECT string_agg(p_name, '|' ORDER BY p_name) AS names, CAST(sum(total) AS DECIMAL(38,2)) AS total_amount, CAST(sum(n) AS BIGINT) AS transactions_count FROM groups JOIN items ON id = node GROUP BY grp""",
    "q5_daily_models": DAILY.format(files=FILES, bridge=BRIDGE, models=_MODELS, count="count(DISTINCT file_id) AS files"),
    "q5_mv": DAILY.format(files=FILES, bridge=BRIDGE, models=_MODELS, count="count(*) AS links"),
    "q5_mv_refresh": DAILY.format(files=f"{FILES} UNION ALL {MORE_FILES}", bridge=f"{BRIDGE} UNION ALL {MORE_LINKS}", models=_MODELS, count="count(*) AS links"),
    "q6_json_filter": Q6,
    "json_filter_events": EVENTS_JSON,
    "json_filter_native": EVENTS_JSON,
    "profile_columns_documents": _profile("documents", _NUMBER),
    "profile_columns_orders": _profile("orders", _ORDERS),
    "profile_columns_lineitem": _profile("lineitem", _LINES),
    "profile_categories_lang": _categories("documents", "lang"),
    "profile_categories_source": _categories("documents", "source"),
    "profile_categories_priority": _categories("orders", "o_orderpriority"),
    "distinct_keys": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_count FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderpriority")),
    "reference_check_labels": _references("labels", "doc_id", "documents", "doc_id", "n_chars > 500"),
    "reference_check_orders": _references("orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0"),
    "reference_check_lineitem": _references("lineitem", "l_partkey", "part", "p_partkey", "p_size > 10"),
    "orphan_rows": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity < 40)",
    "candidate_keys": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "json_types": "SELECT CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'invalid' END AS json_type, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1",
    "date_shapes": f"SELECT CASE WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'valid_iso_date' ELSE 'other_notation' END AS shape, count(*) AS n FROM (SELECT {NOTATION} AS raw FROM orders) WHERE raw IS NOT NULL GROUP BY 1",
    "parse_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 6 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 9 < 6 THEN 'success' WHEN o_orderkey % 9 < 8 THEN 'partial' ELSE 'failed' END AS status FROM orders",
    "parse_amounts": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 > 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 9765625 AS DECIMAL(28,0)) * CAST('0.0000000001' AS DECIMAL(10,10)) ELSE CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(28,10)) END END AS VARCHAR) AS amount, o_orderkey % 10 < 2 AS rejected FROM orders""",
    "parse_hashes": "SELECT c_custkey, CASE WHEN c_custkey % 5 > 2 THEN sha256(c_name) END AS hash, CASE c_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' WHEN 2 THEN 'null' ELSE 'success' END AS status FROM customer",
    "parse_models": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '4,6' WHEN 2 THEN '5,6' ELSE '' END AS ids, CASE s_suppkey % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN 'success' ELSE 'null' END AS status, CASE s_suppkey % 4 WHEN 0 THEN 'unlisted' WHEN 1 THEN 'unlisted' ELSE '' END AS unknown FROM supplier",
    "label_forms": "SELECT DISTINCT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label, CASE WHEN c_nationkey > 9 THEN c_mktsegment ELSE 'gemini-2.5-flash-lite' END AS source FROM customer",
    "lookup_ids": "SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS id FROM (SELECT lang AS label FROM documents UNION SELECT source FROM documents UNION SELECT o_orderpriority FROM orders) WHERE label IS NOT NULL",
    "ingest_accounting": f"WITH {LINES} SELECT count(*) AS read, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'duplicate') AS duplicate FROM classified",
    "ingest_accepted": f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, CAST(file_row_number AS BIGINT) AS source_row FROM classified WHERE status = 'accepted'",
    "ingest_reasons": f"WITH {LINES} SELECT status, reason, count(*) AS n FROM classified GROUP BY 1, 2",
    "ordinals": f"SELECT s_suppkey, CAST(file_row_number + 1 AS BIGINT) AS source_ordinal FROM {_place('supplier')}",
    "resolve_references": "SELECT o_orderkey, c_custkey AS customer_id, CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'matched' END AS match_status FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "required_references": "SELECT o_orderkey, 'Required o_custkey reference does not resolve' AS reason FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT NULL)",
    "resolve_labels": """WITH l AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderpriority <> '5-LOW'))
SELECT o_orderkey, CAST(id AS INTEGER) AS priority_id, CASE WHEN o_orderpriority IS NOT NULL AND id IS NULL THEN 'Unknown o_orderpriority label ' || o_orderpriority END AS reason FROM orders LEFT JOIN l ON label = o_orderpriority""",
    "ingest_rerun": f"WITH {LINES} SELECT count(*) AS read, CAST(0 AS BIGINT) AS accepted, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status <> 'quarantined') AS duplicate FROM classified",
    "ingest_two_keys": """SELECT s_suppkey, CASE WHEN s_suppkey % 20 = 15 THEN 'duplicate' WHEN s_suppkey % 20 = 5 OR (s_suppkey % 10 = 3 AND s_suppkey >= 3) THEN 'quarantined' ELSE 'accepted' END AS status,
   CASE WHEN s_suppkey % 20 = 5 OR s_suppkey % 10 = 3 THEN 'Conflicting unique key' END AS reason FROM supplier""",
    "import_diagnostics": """SELECT CASE WHEN o_orderkey % 9 = 8 THEN 'malformed_date' ELSE 'partial_date' END AS category, 'event_date' AS "column", CASE WHEN o_orderkey % 9 = 8 THEN 'failed' ELSE 'partial' END AS status, count(*) AS n FROM orders WHERE o_orderkey % 9 >= 6 GROUP BY ALL
UNION ALL SELECT 'unresolved_fk', 'o_custkey', 'unresolved', count(*) FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT NULL) HAVING count(*) > 0""",
    "manifest_rows": " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows FROM {t}" for t in ("nation", "orders", "pages")),
    "overview": """SELECT 'shape' AS part, 0 AS position, count(*) || ' x 6' AS content FROM orders
UNION ALL SELECT 'column', i, c FROM (VALUES (0, 'o_orderkey: bigint'), (1, 'o_custkey: bigint'), (2, 'o_orderstatus: string'), (3, 'o_totalprice: double'), (4, 'o_orderdate: timestamp_ntz'), (5, 'o_orderpriority: string')) v(i, c)
UNION ALL SELECT 'row', CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER), '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || coalesce(CAST(o_custkey AS VARCHAR), 'null') || ',"o_orderstatus":' || coalesce('"' || o_orderstatus || '"', 'null')
   || ',"o_totalprice":' || coalesce(CAST(o_totalprice AS VARCHAR), 'null') || ',"o_orderdate":' || coalesce(strftime(o_orderdate, '"%Y-%m-%dT%H:%M:%S.%g"'), 'null') || ',"o_orderpriority":' || coalesce('"' || o_orderpriority || '"', 'null') || '}'
   FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)""",
}
