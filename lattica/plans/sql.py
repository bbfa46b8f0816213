"""Pieces of DuckDB SQL that the oracles share."""


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    bare = f"lower(regexp_replace({norm(x)}, '\\([^)]*\\)', '', 'g'))"
    return f"coalesce(nullif(trim(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ''), 'symbol:' || {bare})"


def digest(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(norm(p) for p in parts) + ")"


def lex(x: str) -> str:
    from lattica.functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({stop}))"


def answer(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"


_PARTS = [
    ("nation", "n_nationkey", 0, "RELATION", "n_name", "part of", "r_name", "nation JOIN region ON n_regionkey = r_regionkey"),
    ("customer", "c_custkey", 0, "RELATION", "c_name", "located in", "n_name", "customer JOIN nation ON c_nationkey = n_nationkey"),
    ("customer", "c_custkey", 1, "ATTRIBUTE", "c_name", "market segment", "c_mktsegment", "customer"),
    ("supplier", "s_suppkey", 0, "RELATION", "s_name", "located in", "n_name", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    ("orders", "o_orderkey", 0, "RELATION", "'Order ' || o_orderkey", "placed by", "c_name", "orders JOIN customer ON o_custkey = c_custkey"),
    ("orders", "o_orderkey", 1, "ATTRIBUTE", "'Order ' || o_orderkey", "status", "o_orderstatus", "orders"),
    ("orders", "o_orderkey", 2, "ATTRIBUTE", "'Order ' || o_orderkey", "priority", "o_orderpriority", "orders"),
    ("lineitem", "l_orderkey", "place * 2", "RELATION", "'Order ' || l_orderkey", "supplied by", "s_name", "lines JOIN supplier ON l_suppkey = s_suppkey"),
    ("lineitem", "l_orderkey", "place * 2 + 1", "RELATION", "'Part ' || l_partkey", "sold in", "'Order ' || l_orderkey", "lines"),
    ("part", "p_partkey", 0, "ATTRIBUTE", "'Part ' || p_partkey", "brand", "p_brand", "part"),
    ("part", "p_partkey", 1, "ATTRIBUTE", "'Part ' || p_partkey", "name", "p_name", "part"),
    ("part", "p_partkey", 2, "ATTRIBUTE", "'Part ' || p_partkey", "type", "p_type", "part"),
]
LINES = "lines AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS place FROM lineitem)"
RAW = LINES + ", raw AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dataset_id, CAST({k} AS VARCHAR) AS sample_id, CAST({k} AS BIGINT) AS source_index, {i} AS triple_index, '{t}' AS triple_type, {s} AS subject, '{p}' AS predicate, {o} AS object, '{d}' AS title FROM {f}" for d, k, i, t, s, p, o, f in _PARTS) + ")"
PARSED = f"{RAW}, t AS (SELECT dataset_id, sample_id, source_index, triple_index, triple_type, {norm('subject')} AS subject, {norm('predicate')} AS predicate, {norm('object')} AS object, title FROM raw WHERE {norm('subject')} <> '' AND {norm('object')} <> '')"
KVS = f"""{PARSED}, kvs AS (
  SELECT *, 0 AS kv_index, subject || ' ' || predicate AS key_text, object AS value_text FROM t
  UNION ALL SELECT *, 1, 'the entity that ' || predicate || ' ' || object || ' is', subject FROM t WHERE triple_type = 'RELATION'
), keyed AS (SELECT *, {digest('lower(key_text)', 'value_text')} AS content_key FROM kvs)"""
RECORDS = f"""{KVS}, firsts AS (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY dataset_id, source_index, triple_index, kv_index) = 1
), kv_records AS (
  SELECT row_number() OVER (ORDER BY dataset_id, source_index, triple_index, kv_index) - 1 AS kv_offset, content_key, key_text, value_text FROM firsts
)"""
NODES = f"""{PARSED}, ends AS (
  SELECT *, 0 AS role, subject AS name FROM t UNION ALL SELECT *, 1, object FROM t
), ekeyed AS (SELECT *, {key('name')} AS canonical_key FROM ends), nfirst AS (
  SELECT *, min(role) OVER (PARTITION BY canonical_key) AS least_role, row_number() OVER (PARTITION BY canonical_key ORDER BY dataset_id, source_index, triple_index, role) AS rn FROM ekeyed
), nodes AS (
  SELECT row_number() OVER (ORDER BY dataset_id, source_index, triple_index, role) AS node_id, canonical_key, name AS canonical_name,
         CASE WHEN least_role = 0 THEN 'entity' ELSE 'literal' END AS kind FROM nfirst WHERE rn = 1
)"""
TRIPLES = f"""{NODES}, tkeyed AS (
  SELECT *, {key('subject')} AS s_key, {key('object')} AS o_key, {digest('triple_type', key('subject'), 'lower(predicate)', key('object'))} AS content_key FROM t
), tfirst AS (
  SELECT * FROM tkeyed QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY dataset_id, source_index, triple_index) = 1
), triples AS (
  SELECT row_number() OVER (ORDER BY dataset_id, source_index, triple_index) AS triple_id, content_key, triple_type, s.node_id AS subject_id, predicate, o.node_id AS object_id,
         CASE WHEN triple_type = 'RELATION' THEN o.kind ELSE 'literal' END AS object_kind
  FROM tfirst JOIN nodes s ON s.canonical_key = s_key JOIN nodes o ON o.canonical_key = o_key
)"""
INCIDENT = f"""{TRIPLES}, inc AS (
  SELECT subject_id AS node_id, triple_id, object_id AS other_id, 0 AS direction FROM triples
  UNION ALL SELECT object_id, triple_id, subject_id, 1 FROM triples WHERE object_kind = 'entity' AND subject_id <> object_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY direction, triple_id) AS rank FROM inc)"""
EDGES = "e AS (SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_quantity / 50.0 AS score, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
