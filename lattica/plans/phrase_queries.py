"""Queries of phrases: directions and texts of edges and paths, prompts, edits, parsers and predicates on names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import phrases, text
from lattica.operators import store
from lattica.plans import sql
from lattica.plans.registry import query
from lattica.plans.store_queries import built
from lattica.sources.tables import table

Spark = SparkSession


@query("f12_kv_direction", f"""WITH {sql.KVS}, x AS (SELECT dataset_id, source_index, triple_index, kv_index, lower(key_text) AS k, lower(value_text) AS v, lower(subject) AS s, lower(object) AS o FROM kvs)
  SELECT dataset_id, source_index, triple_index, kv_index, CASE WHEN v = o THEN 'forward' WHEN v = s THEN 'backward' WHEN contains(k, s) AND NOT contains(k, o) THEN 'forward' WHEN contains(k, o) AND NOT contains(k, s) THEN 'backward' ELSE 'unknown' END AS direction,
    CASE WHEN contains(k, s) AND NOT contains(k, o) THEN 'forward' WHEN contains(k, o) AND NOT contains(k, s) THEN 'backward' ELSE 'unknown' END AS by_key FROM x""")
def kv_direction(spark: Spark, sf_dir: str) -> DataFrame:
    kvs = built(spark, sf_dir).kv_keyed
    told = lambda value: phrases.kv_direction("key_text", value, "subject", "object")
    return kvs.select("dataset_id", "source_index", "triple_index", "kv_index", told("value_text").alias("direction"), told(F.lit("")).alias("by_key"))


@query("f13_path_text", """SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'the part of of the located in of ' || c_name WHEN c_mktsegment = 'BUILDING' THEN 'the part of of which ' || c_name || ' located in' WHEN c_acctbal < 0 THEN 'the part of related to the located in of ' || c_name ELSE c_name || ' located in part of' END AS path FROM customer""")
def path_text(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", phrases.path_text("c_name", F.lit("located in"), F.lit("part of"), F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING").alias("path"))


@query("f14_edge_text", "SELECT p_partkey, array_to_string(list_filter([trim(p_name), 'brand', trim(p_brand), CASE WHEN p_size > 25 THEN trim(p_type) ELSE '' END], lambda x: x <> ''), ' ; ') AS edge FROM part")
def edge_text(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.when(F.col("p_size") > 25, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", phrases.edge_text("p_name", F.lit("brand"), "p_brand", key).alias("edge"))


_TURNS = "t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS b, lag(string_split(coalesce(text, ''), ' '), 1, []) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)"


def _chunked(x: str, size: int) -> str:
    return f"[{x}[i:i + {size - 1}] FOR i IN range(1, len({x}) + 1, {size})]"


@query("f15_changed_tokens", f"WITH {_TURNS}, c AS (SELECT conv_id, turn, {_chunked('a', 16)} AS a, {_chunked('b', 16)} AS b FROM t) SELECT conv_id, turn, coalesce(list_sum([CASE WHEN a[i] IS NOT DISTINCT FROM b[i] THEN 0 ELSE len(b[i]) END FOR i IN range(1, len(b) + 1)]), 0)::BIGINT AS n FROM c")
def changed_tokens(spark: Spark, sf_dir: str) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ")
    before = F.coalesce(F.lag(words).over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("b"), before.alias("a"))
    return t.select("conv_id", "turn", phrases.changed_tokens(F.col("a"), F.col("b"), 16).alias("n"))


def _place(seed: str, n: str) -> str:
    return f"(('0x' || substr(md5({seed}::VARCHAR), 1, 8))::BIGINT % ({n}))"


_W = "w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)"


@query("f16_edited_tokens", f"WITH {_W}, p AS (SELECT doc_id, w, {_place('doc_id', 'len(w)')} AS r, {_place('doc_id', 'len(w) + 1')} AS i FROM w) SELECT doc_id, md5(array_to_string(list_concat(list_append(w[1:r], 'edited'), w[r + 2:]), ' ')) AS replaced, md5(array_to_string(list_concat(list_append(w[1:i], 'edited'), w[i + 1:]), ' ')) AS inserted FROM p")
def edited_tokens(spark: Spark, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    made = lambda insert: F.md5(F.array_join(phrases.edited(F.col("w"), F.col("doc_id"), insert), " "))
    return w.select("doc_id", made(False).alias("replaced"), made(True).alias("inserted"))


@query("a38_update_amplification", f"""WITH {_W}, p AS (SELECT doc_id, w AS a, list_concat(list_append(w[1:{_place('doc_id', 'len(w)')}], 'edited'), w[{_place('doc_id', 'len(w)')} + 2:]) AS b FROM w), c AS (SELECT doc_id, len(b) AS n, {_chunked('a', 64)} AS a, {_chunked('b', 64)} AS b FROM p),
  d AS (SELECT doc_id, n, coalesce(list_sum([CASE WHEN a[i] IS NOT DISTINCT FROM b[i] THEN 0 ELSE len(b[i]) END FOR i IN range(1, len(b) + 1)]), 0)::BIGINT AS changed FROM c) SELECT doc_id, n AS tokens, changed, round(changed / n, 6) AS amplification FROM d""")
def update_amplification(spark: Spark, sf_dir: str) -> DataFrame:
    """One token of each document is replaced; the tokens of the chunks that change have to be encoded again."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("a")).withColumn("b", phrases.edited(F.col("a"), F.col("doc_id"), False))
    out = w.select("doc_id", F.size("b").cast("long").alias("tokens"), phrases.changed_tokens(F.col("a"), F.col("b"), 64).alias("changed"))
    return out.withColumn("amplification", F.round(F.col("changed") / F.col("tokens"), 6))


TEMPLATES = ("What is the %s of %s?", "When was the %s of %s published?", "Where is the %s of %s?", "Who knows the %s of %s?", "When did the %s of %s begin?", "Which language has the %s of %s?")
_ASKED = "asked AS (SELECT c_custkey, [" + ", ".join("'" + t.replace("%s", "' || c_mktsegment || '", 1).replace("%s", "' || c_name || '") + "'" for t in TEMPLATES) + f"][{_place('c_custkey', '6')} + 1] AS question FROM customer)"


def _asked(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", phrases.templated_question("c_name", "c_mktsegment", F.col("c_custkey"), TEMPLATES).alias("question"))


@query("p29_templated_questions", f"WITH {_ASKED} SELECT * FROM asked")
def templated_questions(spark: Spark, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir)


_RELATION = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(question), '{w}')" for w in words) + f" THEN '{r}'" for r, words in phrases.QUESTION_RELATIONS) + f" ELSE '{phrases.OTHER_RELATION}' END"


@query("f19_question_relation", f"WITH {_ASKED} SELECT c_custkey, {_RELATION} AS relation FROM asked")
def question_relation(spark: Spark, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("c_custkey", phrases.question_relation("question").alias("relation"))


@query("f20_answers_of_outputs", """WITH o AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'first' || chr(10) || ' ' || p_name || ' ' || chr(10) || '<|im_end|>rest' WHEN p_size > 30 THEN 'so far <|object_ref_end|>' WHEN p_size > 20 THEN 'The answer to the question is: ' || p_name || '<|im_end|> x' ELSE 'a' || chr(10) || 'The answer to the question is:' || chr(10) || p_brand || '<|endoftext|>' END AS o FROM part),
  t AS (SELECT *, trim(replace(o, '<|endoftext|>', '')) AS c FROM o), m AS (SELECT *, CASE WHEN contains(c, 'The answer to the question is:') THEN trim(string_split(string_split(c, 'The answer to the question is:')[-1], '<|im_end|>')[1], ' ' || chr(10)) END AS marked FROM t)
  SELECT p_partkey, coalesce(nullif(marked, ''), list_filter(list_transform(string_split(string_split(c, '<|im_end|>')[1], chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], '') AS answer, suffix(o, '<|object_ref_end|>') AND NOT contains(o, 'The answer to the question is:') AS again FROM m""")
def answers_of_outputs(spark: Spark, sf_dir: str) -> DataFrame:
    size, mark = F.col("p_size"), F.lit(phrases.ANSWER_MARK)
    out = F.when(size > 40, F.concat(F.lit("first\n "), "p_name", F.lit(" \n<|im_end|>rest"))).when(size > 30, "so far <|object_ref_end|>").when(size > 20, F.concat(mark, F.lit(" "), "p_name", F.lit("<|im_end|> x"))).otherwise(F.concat(F.lit("a\n"), mark, F.lit("\n"), "p_brand", F.lit("<|endoftext|>")))
    return table(spark, sf_dir, "part").select("p_partkey", phrases.answer_of_output(out).alias("answer"), phrases.should_regenerate(out).alias("again"))


@query("f21_context_set_size", "SELECT event_id, 4 * (event_id // 100 + 1) AS size FROM events")
def context_set_size(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", phrases.context_set_size(F.col("event_id")).alias("size"))


@query("f2_canonical_json", "SELECT c_custkey, json_object('key', c_custkey, 'name', c_name, 'nothing', NULL, 'segment', c_mktsegment)::VARCHAR AS json, sha256(json_object('p0', c_name, 'p1', c_mktsegment)::VARCHAR) AS cache_key FROM customer")
def canonical_json(spark: Spark, sf_dir: str) -> DataFrame:
    """compact JSON in order of names, and the cache key made of it."""
    made = phrases.canonical_json(segment=F.col("c_mktsegment"), name=F.col("c_name"), key=F.col("c_custkey"), nothing=F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("json"), phrases.cache_key("c_name", "c_mktsegment").alias("cache_key"))


@query("f23_prompts", f"WITH {_ASKED} SELECT c_custkey, question AS plain, '<|user|>' || chr(10) || question || chr(10) || '<|assistant|>' || chr(10) AS chat, '[INST] ' || question || ' [/INST]' AS instruct FROM asked")
def prompts(spark: Spark, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("c_custkey", *[phrases.prompt("question", family).alias(family) for family in phrases.PROMPTS])


@query("p10_typed_triples", "SELECT p_partkey, unnest([0, 1]) AS place, unnest(['RELATION', 'ATTRIBUTE']) AS triple_type, 'Part ' || p_partkey AS subject, unnest(['brand', 'size']) AS predicate, unnest([p_brand, p_size::VARCHAR]) AS object FROM part")
def typed_triples(spark: Spark, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = F.concat(F.lit("Here they are:\nrelation| Part "), key, F.lit(" |brand| "), "p_brand", F.lit("\nOTHER|a|b|c\nATTRIBUTE|Part "), key, F.lit("|size|"), size, F.lit("|alias\nATTRIBUTE||x|y\nRELATION|a|b"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(phrases.typed_triples(lines)).alias("place", "t")).select("p_partkey", "place", "t.*")


@query("p11_linearised_triples", "SELECT p_partkey, unnest([0, 1, 2]) AS place, unnest([p_name, p_name, 'Part ' || p_partkey]) AS subject, unnest(['brand', 'type', 'name']) AS predicate, unnest([p_brand, p_type, p_name]) AS object FROM part")
def linearised_triples(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("<s><triplet> "), "p_name", F.lit(" <subj> "), "p_brand", F.lit(" <obj> brand <subj> "), "p_type", F.lit(" <obj> type <subj> cut off <triplet> Part "), key, F.lit(" <subj> "), "p_name", F.lit(" <obj> name <triplet> lone</s>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(phrases.linearised_triples(line)).alias("place", "t")).select("p_partkey", "place", "t.*")


@query("p17_value_like_nodes", f"""WITH {sql.TRIPLES}, d AS (SELECT object_id AS node_id, count(*) AS n, count_if(triple_type = 'ATTRIBUTE') AS a FROM triples GROUP BY 1)
  SELECT node_id, regexp_matches(canonical_name, '[0-9]') OR (regexp_matches(canonical_name, '^\\p{{Ll}}') AND len(string_split(canonical_name, ' ')) <= 3) OR coalesce(a >= greatest(1, n // 2), false) AS value_like FROM nodes LEFT JOIN d USING (node_id)""")
def value_like_nodes(spark: Spark, sf_dir: str) -> DataFrame:
    s = built(spark, sf_dir)
    into = s.triples.groupBy(F.col("object_id").alias("node_id")).agg(F.count("*").alias("n"), F.count_if(F.col("triple_type") == "ATTRIBUTE").alias("a"))
    return s.nodes.join(into, "node_id", "left").select("node_id", phrases.is_value_like_node("canonical_name", F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0))).alias("value_like"))


@query("p18_object_reasons", f"""WITH {sql.TRIPLES}, o AS (SELECT triple_id, canonical_name AS x, canonical_key AS k, string_split(canonical_key, ' ') AS w FROM triples JOIN nodes ON node_id = object_id)
  SELECT triple_id, reason FROM (SELECT triple_id, unnest(list_filter([CASE WHEN k IN ('building', 'machinery', 'furniture') THEN 'generic_term_lexicon' END, CASE WHEN len(w) <= 3 AND len(list_filter(w, lambda y: NOT regexp_matches(y, '^\\p{{L}}+$'))) = 0 AND x = lower(x) THEN 'lowercase_common_phrase' END, CASE WHEN len(w) = 1 AND w[1] IN ({", ".join(f"'{r}'" for r in phrases.ROLE_WORDS)}) THEN 'singleton_role_word' END], lambda r: r IS NOT NULL)) AS reason FROM o)""")
def object_reasons(spark: Spark, sf_dir: str) -> DataFrame:
    """The audit of objects, against a lexicon of generic terms."""
    s = built(spark, sf_dir)
    flagged = s.nodes.select(F.col("node_id").alias("object_id"), phrases.object_reasons("canonical_name", ("building", "machinery", "furniture")).alias("reasons")).where(F.size("reasons") > 0)
    return s.triples.join(flagged, "object_id").select("triple_id", F.explode("reasons").alias("reason"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query("p20_anchored_keys", f"""WITH {sql.RECORDS}, f AS (SELECT DISTINCT content_key, arg_min(subject, (dataset_id, source_index, triple_index, kv_index)) OVER (PARTITION BY content_key) AS subject FROM keyed),
  w AS (SELECT kv_offset, list_filter(string_split_regex(lower(regexp_replace(subject, '\\([^)]*\\)', ' ', 'g')), '[^0-9a-z]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)) AS a, list_filter(string_split_regex(lower(regexp_replace(key_text, '\\([^)]*\\)', ' ', 'g')), '[^0-9a-z]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)) AS k FROM kv_records JOIN f USING (content_key))
  SELECT kv_offset, len(list_intersect(a, k)) >= CASE WHEN len(list_distinct(a)) >= 3 THEN 2 ELSE 1 END AS anchored FROM w""")
def anchored_keys(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether a key names its triple's subject: one of its words, or two where it has three or more."""
    s = built(spark, sf_dir)
    first = store.kv_records(s.laid, s.pair_numbers, "subject")
    both = first.select("kv_offset", F.array_distinct(text.anchor_tokens("subject")).alias("a"), text.anchor_tokens("key_text").alias("k"))
    need = F.when(F.size("a") >= 3, 2).otherwise(1)
    return both.select("kv_offset", (F.size(F.array_intersect("a", "k")) >= need).alias("anchored"))


@query("p21_keys_without_anchor", f"WITH {sql.PARSED} SELECT DISTINCT subject, predicate, predicate AS forward, 'the ' || predicate || ' is' AS owned FROM t WHERE dataset_id IN ('customer', 'orders', 'part')")
def keys_without_anchor(spark: Spark, sf_dir: str) -> DataFrame:
    t = built(spark, sf_dir).keyed.where("dataset_id in ('customer', 'orders', 'part')")
    forward, owned = F.concat_ws(" ", "subject", "predicate"), F.concat(F.lit("the "), "predicate", F.lit(" of "), "subject", F.lit(" is"))
    return t.select("subject", "predicate", phrases.without_anchor(forward, F.col("subject")).alias("forward"), phrases.without_anchor(owned, F.col("subject")).alias("owned")).distinct()


@query("p28_prompt_lines", "WITH p AS (SELECT l_orderkey, list(DISTINCT p_name) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), s AS (SELECT l_orderkey, list_sort(names) AS n FROM p) SELECT l_orderkey, 'Facts:' || chr(10) || array_to_string([i || '. ' || n[i] FOR i IN range(1, len(n) + 1)], chr(10)) AS prompt FROM s")
def prompt_lines(spark: Spark, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_name")).alias("n")).select("l_orderkey", phrases.prompt_lines(F.col("n"), "Facts:").alias("prompt"))
