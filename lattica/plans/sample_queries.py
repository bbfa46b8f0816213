"""Queries of samples in many shapes: readers, contexts, triples, hops, supporting and oracle contexts, documents of a memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import reports, store
from lattica.plans.registry import query
from lattica.sources import samples
from lattica.sources.tables import sample_json, table

Spark = SparkSession

#: What the samples of ``sample_json`` hold, said in SQL without their JSON.
_S = """c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_name, n_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' || c_custkey WHEN 'FURNITURE' THEN '3hop1_' || c_custkey ELSE c_custkey::VARCHAR END AS sample_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
  o AS (SELECT o_custkey AS k, o_orderkey, 'Order ' || o_orderkey AS title, o_orderstatus AS st, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders)"""
_CTX = f"""{_S}, ctx AS (SELECT sample_id, k AS source_index, ord, title, CASE seg WHEN 'BUILDING' THEN ['Status ' || st || '.', 'Priority ' || pr || '.'] WHEN 'MACHINERY' THEN ['Status ' || st || '.'] ELSE ['Status ' || st || '. Priority ' || pr || '.'] END AS sentences, seg = 'FURNITURE' AND st = 'O' AS supporting
    FROM c JOIN o USING (k) WHERE seg IN ('BUILDING', 'MACHINERY', 'FURNITURE') UNION ALL SELECT sample_id, k, 0, c_name, ['Segment AUTOMOBILE.'], false FROM c WHERE seg = 'AUTOMOBILE')"""


def _parsed(spark: Spark, sf_dir: str) -> DataFrame:
    return samples.parse(sample_json(spark, sf_dir))


@query("p1_contexts", f"WITH {_CTX} SELECT sample_id, source_index, ord, title, array_to_string(sentences, '|') AS sentences, supporting FROM ctx")
def contexts(spark: Spark, sf_dir: str) -> DataFrame:
    """The contexts of samples of five shapes."""
    return samples.contexts(_parsed(spark, sf_dir)).select("sample_id", "source_index", "ord", "title", F.array_join("sentences", "|").alias("sentences"), "supporting")


@query("p2_questions", f"WITH {_S} SELECT sample_id, k AS source_index, CASE WHEN seg = 'AUTOMOBILE' THEN 'Who is ' || c_name || '?' ELSE 'Where is ' || c_name || '?' END AS question, n_name AS answer FROM c")
def questions(spark: Spark, sf_dir: str) -> DataFrame:
    return samples.questions(_parsed(spark, sf_dir))


@query("p3_titled_texts", f"WITH {_CTX} SELECT sample_id, ord, 'Title: ' || title || chr(10) || array_to_string(sentences, ' ') AS text, title AS back, TRY_CAST(regexp_extract(title, '^Order ([0-9]+)$', 1) AS BIGINT) AS number FROM ctx")
def titled_texts(spark: Spark, sf_dir: str) -> DataFrame:
    c = samples.contexts(_parsed(spark, sf_dir)).withColumn("text", samples.titled_text("title", F.array_join("sentences", " ")))
    return c.select("sample_id", "ord", "text", samples.title_of_text("text").alias("back"), samples.safe_int(F.regexp_replace("title", "^Order ", "")).alias("number"))


_OWN = f"""{_S}, own AS (SELECT sample_id, k AS source_index, 0 AS triple_index, 'RELATION' AS triple_type, c_name AS subject, 'located in' AS predicate, n_name AS object, '' AS title FROM c WHERE seg = 'HOUSEHOLD'),
  inner_ AS (SELECT sample_id, k AS source_index, ord::INT AS triple_index, CASE WHEN seg = 'FURNITURE' THEN 'RELATION' ELSE 'ATTRIBUTE' END AS triple_type, title AS subject, CASE WHEN seg = 'FURNITURE' THEN 'placed by' ELSE 'status' END AS predicate, CASE WHEN seg = 'FURNITURE' THEN c_name ELSE st END AS object, title, seg FROM c JOIN o USING (k) WHERE seg IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD'))"""


@query("p5_triples_of_samples", f"WITH {_OWN} SELECT * FROM own UNION ALL SELECT * EXCLUDE (seg) FROM inner_ WHERE seg <> 'HOUSEHOLD'")
def triples_of_samples(spark: Spark, sf_dir: str) -> DataFrame:
    """P5: a sample's own triples win over those of its contexts."""
    return samples.triples(_parsed(spark, sf_dir), "samples").drop("dataset_id")


@query("p6_triples_of_contexts", f"WITH {_OWN} SELECT * EXCLUDE (seg) FROM inner_ UNION ALL SELECT * FROM own WHERE sample_id NOT IN (SELECT sample_id FROM inner_)")
def triples_of_contexts(spark: Spark, sf_dir: str) -> DataFrame:
    """The triples of its contexts win over a sample's own."""
    return samples.triples(_parsed(spark, sf_dir), "samples", context_first=True).drop("dataset_id")


@query("q1_store_of_samples", f"WITH {_OWN}, t AS (SELECT * FROM own UNION ALL SELECT * EXCLUDE (seg) FROM inner_ WHERE seg <> 'HOUSEHOLD'), k AS (SELECT lower(regexp_replace(subject, '[^A-Za-z0-9]+', ' ', 'g')) AS k FROM t UNION SELECT lower(regexp_replace(object, '[^A-Za-z0-9]+', ' ', 'g')) FROM t) SELECT (SELECT count(*) FROM t) AS n_triples, (SELECT count(DISTINCT k) FROM k) AS n_nodes")
def store_of_samples(spark: Spark, sf_dir: str) -> DataFrame:
    """Q1: from JSON samples to the tables of a store."""
    s = store.Store(samples.triples(_parsed(spark, sf_dir), "samples"))
    return s.triples.agg(F.count("*").alias("n_triples")).crossJoin(s.nodes.agg(F.count("*").alias("n_nodes")))


_HOPS = f"""{_S}, n AS (SELECT c.k, sample_id, seg, count(o.k) AS n, count(DISTINCT title) FILTER (st = 'F') AS f FROM c LEFT JOIN o USING (k) GROUP BY ALL),
  h AS (SELECT sample_id, CASE seg WHEN 'MACHINERY' THEN nullif(n, 0) WHEN 'FURNITURE' THEN 3 WHEN 'BUILDING' THEN nullif(f, 0) END::INT AS hops FROM n)"""


@query("p26_hops", f"WITH {_HOPS} SELECT sample_id, hops, CASE WHEN hops IS NULL THEN 'unknown' WHEN hops >= 4 THEN '4+' ELSE hops::VARCHAR END AS bucket FROM h")
def hops(spark: Spark, sf_dir: str) -> DataFrame:
    """Hops by evidences, by id, by titles of supporting facts."""
    return samples.hops(_parsed(spark, sf_dir))


@query("q23_hop_summary", f"WITH {_HOPS}, b AS (SELECT CASE WHEN hops IS NULL THEN 'unknown' WHEN hops >= 4 THEN '4+' ELSE hops::VARCHAR END AS bucket, sample_id FROM h) SELECT regexp_extract(sample_id, '^([a-z]|3hop)', 1) AS source, bucket, count(*) AS n FROM b GROUP BY 1, 2")
def hop_summary(spark: Spark, sf_dir: str) -> DataFrame:
    h = samples.hops(_parsed(spark, sf_dir))
    return h.groupBy(F.regexp_extract("sample_id", "^([a-z]|3hop)", 1).alias("source"), "bucket").agg(F.count("*").alias("n"))


@query("j20_supporting_titles", f"WITH {_S} SELECT DISTINCT sample_id, title FROM c JOIN o USING (k) WHERE (seg = 'BUILDING' AND st = 'F') OR (seg = 'FURNITURE' AND st = 'O')")
def supporting_titles(spark: Spark, sf_dir: str) -> DataFrame:
    """Titles of supporting facts, else of the contexts marked so."""
    return samples.supporting_titles(_parsed(spark, sf_dir))


@query("j19_oracle_contexts", f"""WITH {_CTX}, a AS (SELECT sample_id, ord, array_to_string(sentences, ' ') AS text, CASE WHEN ord = 0 THEN 0 WHEN title IN (SELECT 'Order ' || o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 1 WHEN supporting THEN 2 END AS prio FROM ctx),
  f AS (SELECT sample_id, text, min((prio, ord)) AS p FROM a WHERE prio IS NOT NULL GROUP BY 1, 2) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY p, text) - 1 AS place, text FROM f""")
def oracle_contexts(spark: Spark, sf_dir: str) -> DataFrame:
    """The first context, those with titles of finished orders, and those marked; in this order, each text once."""
    ctx = samples.contexts(_parsed(spark, sf_dir))
    titles = ctx.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title")), "title", "left_semi").select("sample_id", "title")
    return samples.oracle_contexts(ctx, titles, ctx.select("sample_id").distinct().withColumn("ord", F.lit(0)))


@query("q24_memory_documents", f"WITH {_CTX}, d AS (SELECT source_index, ord, title, array_to_string(sentences, ' ') AS text FROM ctx) SELECT text, arg_min(title, (source_index, ord)) AS title, count(*) AS copies FROM d GROUP BY text")
def memory_documents(spark: Spark, sf_dir: str) -> DataFrame:
    """Contexts of all samples as documents, each text once with its first title."""
    d = samples.contexts(_parsed(spark, sf_dir)).select("source_index", "ord", "title", F.array_join("sentences", " ").alias("text"))
    first = reports.keep_first(d, ["text"], ["source_index", "ord"]).select("text", "title")
    return first.join(d.groupBy("text").agg(F.count("*").alias("copies")), "text")


@query("j26_triples_into_documents", f"WITH {_OWN}, i AS (SELECT sample_id, title, subject || '|' || predicate || '|' || object AS t FROM inner_) SELECT sample_id, title, count(*) AS n, array_to_string(list_sort(list(t)), chr(10)) AS triples FROM i GROUP BY 1, 2")
def triples_into_documents(spark: Spark, sf_dir: str) -> DataFrame:
    """Triples put back to the contexts they came from; contexts without any are left out."""
    t = samples.triples(_parsed(spark, sf_dir), "samples", context_first=True).where("title != ''")
    lines = F.array_sort(F.collect_list(F.concat_ws("|", "subject", "predicate", "object")))
    return t.groupBy("sample_id", "title").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("triples"))


@query("p13_normalised_triples", f"""WITH {_OWN}, n AS (SELECT sample_id, triple_index, triple_type, trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object FROM inner_)
  SELECT sample_id, subject, predicate, object, CASE WHEN triple_type = 'ATTRIBUTE' THEN 'the ' || predicate || ' of ' || subject || ' is' ELSE subject || ' ' || predicate END AS key_text FROM n QUALIFY row_number() OVER (PARTITION BY sample_id, lower(predicate), lower(object) ORDER BY triple_index) = 1""")
def normalised_triples(spark: Spark, sf_dir: str) -> DataFrame:
    """Triples under any field names in one form with new keys, the first of those alike but for case kept (here by predicate and object)."""
    t = store.parsed(samples.triples(_parsed(spark, sf_dir), "samples", context_first=True).where("title != ''"))
    first = reports.keep_first(t.withColumns({"p": F.lower("predicate"), "o": F.lower("object")}), ["sample_id", "p", "o"], ["triple_index"])
    return store.templated_kvs(first).where("kv_index = 0").select("sample_id", "subject", "predicate", "object", "key_text")


@query("p23_samples_by_ids", f"WITH {_S} SELECT sample_id FROM c WHERE k IN (SELECT doc_id FROM labels WHERE quality = 1)")
def samples_by_ids(spark: Spark, sf_dir: str) -> DataFrame:
    """Samples whose index is in a set."""
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("source_index")).distinct()
    return _parsed(spark, sf_dir).join(ids, "source_index", "left_semi").select("sample_id")


@query("p14_slim_samples", f"WITH {_CTX} SELECT sample_id, count(*)::INT AS n_contexts, array_to_string(list_transform(list(title ORDER BY ord)[1:3], lambda t: substr(t, 1, 7)), '|') AS titles FROM ctx GROUP BY 1")
def slim_samples(spark: Spark, sf_dir: str) -> DataFrame:
    """Of each sample the first three titles, cut to seven characters."""
    held = samples.contexts(_parsed(spark, sf_dir)).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("c"))
    return held.select("sample_id", F.size("c").alias("n_contexts"), F.array_join(F.transform(F.slice("c", 1, 3), lambda x: F.substring(x["title"], 1, 7)), "|").alias("titles"))
