"""Queries of reports: upserts and merges, folds, percentiles by rank, answer placement, recall, sinks, traces and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import graph, metrics, reports, search
from lattica.plans import sql
from lattica.plans.graph_queries import _Q, question_edges
from lattica.plans.registry import query
from lattica.plans.store_queries import built
from lattica.sources import tables
from lattica.sources.tables import table

Spark = SparkSession


@query("a6_dataset_upsert", "SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (event_type <> 'error'), '') AS event_type FROM events GROUP BY 1")
def dataset_upsert(spark: Spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("event_type"))
    return reports.latest_non_empty(e, "user_id", "event_type", "event_id")


@query("a8_ingest_stats", f"WITH {sql.TRIPLES} SELECT dataset_id, count(DISTINCT sample_id) AS samples, count(*) AS triples_seen, count(DISTINCT content_key) AS triples_distinct, sum(CASE WHEN triple_type = 'RELATION' THEN 2 ELSE 1 END)::BIGINT AS kvs_seen FROM tkeyed GROUP BY 1")
def ingest_stats(spark: Spark, sf_dir: str) -> DataFrame:
    k = built(spark, sf_dir).keyed
    return k.groupBy("dataset_id").agg(F.count_distinct("sample_id").alias("samples"), F.count("*").alias("triples_seen"), F.count_distinct("content_key").alias("triples_distinct"), F.sum(F.when(F.col("triple_type") == "RELATION", 2).otherwise(1)).alias("kvs_seen"))


@query("a9_edge_shapes", f"WITH {sql.TRIPLES} SELECT triple_type, count(*) AS n, count(DISTINCT (least(subject_id, object_id), greatest(subject_id, object_id))) AS pairs, count_if(subject_id = object_id) AS loops FROM triples GROUP BY 1")
def edge_shapes(spark: Spark, sf_dir: str) -> DataFrame:
    t = built(spark, sf_dir).triples
    return t.groupBy("triple_type").agg(F.count("*").alias("n"), F.count_distinct(F.struct(F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id"))).alias("pairs"), F.count_if(F.col("subject_id") == F.col("object_id")).alias("loops"))


@query("a12_nearest_rank", "WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, " + ", ".join(f"max(o_totalprice) FILTER (i = round_even({p} / 100 * (n - 1), 0)) AS p{p}" for p in (50, 90, 99)) + " FROM r GROUP BY 1")
def nearest_rank(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], (50, 90, 99))


@query("a18_audit_samples", f"WITH {sql.TRIPLES}, o AS (SELECT object_id, predicate, triple_id, subject_id FROM triples WHERE triple_type = 'ATTRIBUTE') SELECT object_id, predicate, triple_id, subject_id, row_number() OVER (PARTITION BY object_id, predicate ORDER BY triple_id) AS place FROM o QUALIFY place <= 3")
def audit_samples(spark: Spark, sf_dir: str) -> DataFrame:
    """The first three triples of each attribute value, as an audit shows them."""
    t = built(spark, sf_dir).triples.where("triple_type = 'ATTRIBUTE'").withColumn("score", F.lit(0.0))
    w = Window.partitionBy("object_id", "predicate").orderBy("triple_id")
    return graph.per_source_cap(t, 3, ["object_id", "predicate"], tie="triple_id").select("object_id", "predicate", "triple_id", "subject_id", F.row_number().over(w).alias("place"))


@query("a19_best_of_merge", "SELECT o_custkey, arg_max(o_orderkey, (o_orderstatus, o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def best_of_merge(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.best_of(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_totalprice"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("a20_content_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lang, n_chars, source, text")
def content_dedup(spark: Spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(reports.content_key(d, ["doc_id"]).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("fingerprint")


@query("a21_text_dedup", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def text_dedup(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.keep_first(table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("a22_keep_first", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) = 1")
def keep_first(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.keep_first(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("a23_merged_stages", "WITH a AS (SELECT 0 AS part, l_partkey AS k, l_suppkey AS v, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2, 3), b AS (SELECT 1 AS part, l_partkey AS k, l_suppkey AS v, min(l_orderkey) AS o FROM lineitem WHERE l_linestatus = 'O' GROUP BY 2, 3) SELECT part, k, v, o FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY k, v ORDER BY part, o) = 1")
def merged_stages(spark: Spark, sf_dir: str) -> DataFrame:
    """What a second stage adds to the first; what both have comes from the first."""
    line = table(spark, sf_dir, "lineitem")
    stage = lambda where: line.where(where).groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v")).agg(F.min("l_orderkey").alias("o"))
    return reports.ordered_union([stage("l_returnflag = 'R'"), stage("l_linestatus = 'O'")], ["k", "v"], ["o"]).select("part", "k", "v", "o")


@query("a24_folded_tails", """WITH t AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS n FROM part GROUP BY 1)
  SELECT p_brand, list_reduce(n, lambda a, b: CASE WHEN contains(b, a) THEN b WHEN contains(a, b) THEN a WHEN length(a) < 50 AND length(b) < 50 THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(a || ',' || b, ','), lambda x: trim(x)), lambda x: x <> ''))), ', ') ELSE a END) AS p_name FROM t""")
def folded_tails(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.fold_tails(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey")


@query("a25_best_edge", f"WITH {_Q} SELECT qid, src, dst, 'sold' AS relation, arg_max(eid, (score, -eid)) AS eid, max(score) AS score FROM qe GROUP BY qid, src, dst")
def best_edge(spark: Spark, sf_dir: str) -> DataFrame:
    """Of several edges of one relation between two nodes the best scored one."""
    return graph.best_edge(question_edges(spark, sf_dir).withColumn("relation", F.lit("sold"))).select("qid", "src", "dst", "relation", "eid", "score")


@query("a28_node_features", f"WITH {sql.EDGES}, i AS (SELECT dst AS node, count(*) AS n_in, round(avg(score), 6) AS mean_in, max(score) AS max_in FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS n_out, round(avg(score), 6) AS mean_out, max(score) AS max_out FROM e GROUP BY 1) SELECT coalesce(i.node, o.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(mean_in, 0) AS mean_in, coalesce(max_in, 0) AS max_in, coalesce(n_out, 0) AS n_out, coalesce(mean_out, 0) AS mean_out, coalesce(max_out, 0) AS max_out FROM i FULL JOIN o ON i.node = o.node")
def node_features(spark: Spark, sf_dir: str) -> DataFrame:
    f = graph.node_features(tables.edges(spark, sf_dir), ["score"])
    return f.select("node", "n_in", F.round("mean_in_score", 6).alias("mean_in"), F.col("max_in_score").alias("max_in"), "n_out", F.round("mean_out_score", 6).alias("mean_out"), F.col("max_out_score").alias("max_out"))


_SINKS = f"{_Q}, sk AS (SELECT qid, eid, score, src % 3 = 0 AS is_answer FROM qe WHERE (qid, dst) NOT IN (SELECT (qid, src) FROM qe)), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid) AS rank FROM sk), bk AS (SELECT *, min(rank) FILTER (is_answer) OVER (PARTITION BY qid) AS best FROM rk)"


def _sink_edges(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    ends = graph.sinks(e).withColumnRenamed("node", "dst")
    return reports.sink_ranks(e.join(ends, ["qid", "dst"], "left_semi").select("qid", "eid", "score", (F.col("src") % 3 == 0).alias("is_answer")))


@query("w5_sink_ranks", f"WITH {_SINKS} SELECT qid, eid, is_answer, rank, best FROM bk")
def sink_ranks(spark: Spark, sf_dir: str) -> DataFrame:
    return _sink_edges(spark, sf_dir).select("qid", "eid", "is_answer", "rank", "best")


@query("a30_hit_curve", f"WITH {_SINKS}, p AS (SELECT qid, max(rank) AS n, min(best) AS best FROM bk GROUP BY 1) SELECT k, count_if(best <= k) AS hits, count(*) AS questions FROM p, unnest(range(1, n + 1)) AS t(k) GROUP BY k")
def hit_curve(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.hit_curve(_sink_edges(spark, sf_dir))


@query("a32_answer_placement", f"WITH {_SINKS} SELECT count(DISTINCT qid) AS questions, count(DISTINCT qid) FILTER (best IS NOT NULL) AS with_answer, count(DISTINCT qid) FILTER (best = 1) AS answer_first, count_if(is_answer) AS answer_edges, count_if(NOT is_answer) AS other_edges, round(avg((best <= 3)::INT) FILTER (rank = 1), 6) AS top3 FROM bk")
def answer_placement(spark: Spark, sf_dir: str) -> DataFrame:
    s = _sink_edges(spark, sf_dir)
    q = lambda c: F.count_distinct(F.when(c, F.col("qid")))
    top3 = F.round(F.avg(F.when(F.col("rank") == 1, (F.col("best") <= 3).cast("int"))), 6)
    return s.agg(F.count_distinct("qid").alias("questions"), q(F.col("best").isNotNull()).alias("with_answer"), q(F.col("best") == 1).alias("answer_first"), reports.count_where(F.col("is_answer")).alias("answer_edges"), reports.count_where(~F.col("is_answer")).alias("other_edges"), top3.alias("top3"))


_RECALL = "r AS (SELECT l.l_orderkey, count(DISTINCT l.l_partkey) AS gold, count(DISTINCT l.l_partkey) FILTER (l.l_discount <= 0.05) AS found FROM lineitem l GROUP BY 1)"


@query("a31_metric_means", f"WITH {_RECALL} SELECT o_orderpriority, count(*) AS samples, round(avg((found > 0)::INT), 6) AS hit, round(avg((found = gold)::INT), 6) AS all_hit, round(avg(found / gold), 6) AS recall FROM r JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def metric_means(spark: Spark, sf_dir: str) -> DataFrame:
    """Retrieval metrics of each sample and their means by slice."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("gold"), F.collect_set(F.when(F.col("l_discount") <= 0.05, F.col("l_partkey"))).alias("found"))
    each = sets.select("l_orderkey", *metrics.retrieval(F.col("found"), F.col("gold")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return each.join(o, "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("samples"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "all_hit", "recall")])


@query("a37_stage_latencies", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) / sum(avg(value)) OVER (), 6) AS share FROM events GROUP BY 1")
def stage_latencies(spark: Spark, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    total = means.agg(F.sum("m").alias("t"))
    return means.crossJoin(F.broadcast(total)).select("event_type", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") / F.col("t"), 6).alias("share"))


_TRACE = "tr AS (SELECT l_orderkey, l_quantity AS b, l_extendedprice AS a FROM lineitem), sh AS (SELECT *, greatest(b / sum(b) OVER (PARTITION BY l_orderkey), 1e-12) AS p, greatest(a / sum(a) OVER (PARTITION BY l_orderkey), 1e-12) AS q FROM tr)"


@query("a39_trace_stats", f"WITH {_TRACE} SELECT l_orderkey, round(sum(b), 4) AS sum_before, round(sum(a), 4) AS sum_after, max(b) AS max_before, max(a) AS max_after, round(-sum(p * ln(p)) + 0, 6) AS entropy_before, round(-sum(q * ln(q)) + 0, 6) AS entropy_after, round(sum(q * ln(q / p)), 6) AS divergence FROM sh GROUP BY 1")
def trace_stats(spark: Spark, sf_dir: str) -> DataFrame:
    """Two weightings of the lines of each order against each other."""
    s = reports.trace_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice")
    return s.select("l_orderkey", *[F.round(c, 4).alias(c) for c in ("sum_before", "sum_after")], "max_before", "max_after", *[(F.round(c, 6) + 0.0).alias(c) for c in ("entropy_before", "entropy_after", "divergence")])


@query("w13_level_prizes", f"""WITH {_Q}, l AS (SELECT qid, eid, dense_rank() OVER (PARTITION BY qid ORDER BY score DESC) AS level FROM qe), c AS (SELECT qid, level, count(*) AS n FROM l WHERE level <= 5 GROUP BY 1, 2), a AS (SELECT qid, list(n ORDER BY level) AS n FROM c GROUP BY 1),
  f AS (SELECT qid, list_reduce(n, lambda acc, x: {{'mass': acc.mass - 1, 'most': least(acc.mass / x, acc.most) * 0.99, 'out': list_append(acc.out, least(acc.mass / x, acc.most))}}, {{'mass': len(n)::DOUBLE, 'most': len(n)::DOUBLE, 'out': []::DOUBLE[]}}) AS r FROM a)
  SELECT qid, eid, round(coalesce(r.out[level], 0), 6) AS prize FROM l JOIN f USING (qid)""")
def level_prizes(spark: Spark, sf_dir: str) -> DataFrame:
    return reports.level_prizes(question_edges(spark, sf_dir), ["qid"], "score", 5).select("qid", "eid", F.round("prize", 6).alias("prize"))


@query("w14_day_rollovers", "WITH e AS (SELECT user_id, event_id, hour(ts) * 60 + minute(ts) AS clock FROM events), b AS (SELECT *, coalesce((clock < lag(clock) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS back FROM e) SELECT user_id, event_id, sum(back) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS day FROM b")
def day_rollovers(spark: Spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("clock", F.hour("ts") * 60 + F.minute("ts"))
    return reports.rollovers(e, ["user_id"], ["event_id"], "clock").select("user_id", "event_id", "day")


@query("a40_rolled_up_buckets", "SELECT source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY ROLLUP (1, 2)")
def rolled_up_buckets(spark: Spark, sf_dir: str) -> DataFrame:
    """Counts by source and length bucket with their totals."""
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return table(spark, sf_dir, "documents").select("source", bucket.alias("bucket")).rollup("source", "bucket").agg(F.count("*").alias("n"))


_TURNS = f"a AS (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations QUALIFY g IS NOT NULL AND text IS NOT NULL), w AS (SELECT conv_id, turn, {sql.answer('p')} AS pa, {sql.answer('g')} AS ga, list_filter(string_split({sql.answer('p')}, ' '), lambda x: x <> '') AS pw, list_filter(string_split({sql.answer('g')}, ' '), lambda x: x <> '') AS gw FROM a)"


def _pairs(spark: Spark, sf_dir: str) -> DataFrame:
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("p"), nxt.alias("g")).where("g is not null and p is not null")


@query("f7_set_f1", f"WITH {_TURNS}, c AS (SELECT conv_id, turn, len(pw) AS np, len(gw) AS ng, len(list_intersect(pw, gw)) AS same FROM w) SELECT conv_id, turn, round(CASE WHEN np = 0 OR ng = 0 OR same = 0 THEN 0 ELSE 2 * same / (np + ng) END, 6) AS f1 FROM c")
def set_f1(spark: Spark, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.set_f1(metrics.words("p"), metrics.words("g")), 6).alias("f1"))


@query("a33_answer_report", f"WITH {_TURNS}, c AS (SELECT conv_id, (pa = ga)::INT AS em, (ga <> '' AND contains(pa, ga))::INT AS held, len(pw) AS np, len(gw) AS ng, len(list_intersect(pw, gw)) AS same FROM w) SELECT conv_id, count(*) AS n, round(avg(em), 6) AS em, round(avg(held), 6) AS contained, round(avg(CASE WHEN np = 0 OR ng = 0 OR same = 0 THEN 0 ELSE 2 * same / (np + ng) END), 6) AS set_f1 FROM c GROUP BY 1")
def answer_report(spark: Spark, sf_dir: str) -> DataFrame:
    """Exact match, containment and F1 of all predictions of a conversation."""
    each = _pairs(spark, sf_dir).select("conv_id", metrics.exact_match("p", "g").alias("em"), metrics.contained("p", "g").alias("contained"), metrics.set_f1(metrics.words("p"), metrics.words("g")).alias("set_f1"))
    return each.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("em", "contained", "set_f1")])


_HIST = "h AS (SELECT user_id, event_id, event_type AS prediction, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS gold, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round FROM events)"


@query("j16_edit_transitions", f"""WITH {_HIST}, b AS (SELECT * FROM h WHERE round = 0), t AS (SELECT * FROM h WHERE round = 5), o AS (SELECT t.user_id, t.prediction, t.gold, bool_or(x.gold = t.prediction) AS stale FROM t JOIN h x ON x.user_id = t.user_id AND x.round < t.round GROUP BY ALL)
  SELECT count(*) AS shared, coalesce(sum((b.prediction = b.gold AND o.prediction = o.gold)::INT), 0)::BIGINT AS stayed_right, coalesce(sum((b.prediction = b.gold AND o.prediction <> o.gold AND stale)::INT), 0)::BIGINT AS leaked, coalesce(sum((b.prediction = b.gold AND o.prediction <> o.gold AND NOT stale)::INT), 0)::BIGINT AS other_error,
    coalesce(sum((b.prediction <> b.gold AND o.prediction = o.gold)::INT), 0)::BIGINT AS gained FROM b JOIN o USING (user_id)""")
def edit_transitions(spark: Spark, sf_dir: str) -> DataFrame:
    """Of answers right before the edits, those still right, those wrong with a former answer (leaked), and other errors."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    h = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("prediction"), F.lead("event_type").over(w).alias("gold"), (F.row_number().over(w) - 1).alias("round"))
    return metrics.edit_transitions(h, "user_id", 0, 5)


@query("j25_aligned_rounds", "SELECT a.conv_id, a.turn, a.role = b.role AS same_role, md5(coalesce(a.text, '')) = md5(coalesce(b.text, '')) AS same_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def aligned_rounds(spark: Spark, sf_dir: str) -> DataFrame:
    """Two rounds side by side by place; a place that only one of them has is left out."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("role_b"), F.md5(F.coalesce("text", F.lit(""))).alias("h_b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("role") == F.col("role_b")).alias("same_role"), (F.col("h") == F.col("h_b")).alias("same_text"))


@query("q15_answer_hit_cells", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rank, l_returnflag = 'R' AS is_answer FROM lineitem), b AS (SELECT l_orderkey, count(*) AS size, min(rank) FILTER (is_answer) AS best FROM r GROUP BY 1) SELECT size, coalesce(best, 0) AS best, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY size), 6) AS share FROM b GROUP BY 1, 2")
def answer_hit_cells(spark: Spark, sf_dir: str) -> DataFrame:
    """The heat map of how many candidates a question has against where its first answer stands (0: none)."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    b = table(spark, sf_dir, "lineitem").withColumn("rank", rank).groupBy("l_orderkey").agg(F.count("*").alias("size"), F.coalesce(F.min(F.when(F.col("l_returnflag") == "R", F.col("rank"))), F.lit(0)).alias("best"))
    cells = b.groupBy("size", "best").agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("size")), 6))


@query("y12_refusals", "WITH p AS (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS known, p_name LIKE '%a%' AS answers FROM part) SELECT count_if(NOT known AND NOT answers) AS true_refusals, count_if(known AND NOT answers) AS false_refusals, count_if(known AND answers) AS answered, count_if(NOT known AND answers) AS missed, round(count_if(NOT known AND NOT answers) / greatest(count_if(NOT answers), 1), 6) AS precision FROM p")
def refusals(spark: Spark, sf_dir: str) -> DataFrame:
    """Questions about rows outside the knowledge base are to be refused; counts of the four cases."""
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("known")).distinct()
    p = table(spark, sf_dir, "part").join(known, "p_partkey", "left").select(F.coalesce("known", F.lit(False)).alias("known"), F.col("p_name").contains("a").alias("answers"))
    k, a = F.col("known"), F.col("answers")
    return p.agg(F.count_if(~k & ~a).alias("true_refusals"), F.count_if(k & ~a).alias("false_refusals"), F.count_if(k & a).alias("answered"), F.count_if(~k & a).alias("missed"), F.round(F.count_if(~k & ~a) / F.greatest(F.count_if(~a), F.lit(1)), 6).alias("precision"))


@query("y13_attention_accuracy", f"WITH {sql.EDGES}, w AS (SELECT l_linenumber AS layer, l_orderkey AS row, dst AS kv, sum(score) AS weight FROM e GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY layer, row ORDER BY round(weight, 9) DESC, kv) AS rank, kv = max(kv) OVER (PARTITION BY layer, row) AS gold FROM w) SELECT layer, count(*) AS n, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5 FROM r WHERE gold GROUP BY 1")
def attention_accuracy(spark: Spark, sf_dir: str) -> DataFrame:
    """Head-summed weights by layer and row; how often the true item has the largest, and one of the five largest."""
    e = tables.edges(spark, sf_dir)
    w = e.groupBy(F.col("l_linenumber").alias("layer"), F.col("l_orderkey").alias("row"), F.col("dst").alias("kv")).agg(F.round(F.sum("score"), 9).alias("weight"))
    gold = F.col("kv") == F.max("kv").over(Window.partitionBy("layer", "row"))
    ranks = search.retrieval_ranks(w.select(F.struct("layer", "row").alias("qid"), F.col("kv").alias("item"), F.col("weight").alias("score"), gold.alias("is_gold")))
    return ranks.groupBy("qid.layer").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("rank") <= 5).cast("int")), 6).alias("top5"))


@query("y20_flattened_sizes", "WITH a AS (SELECT event_type, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT event_type, i - 1 AS idx, v[i] AS value FROM a, unnest(range(1, len(v) + 1)) AS t(i)")
def flattened_sizes(spark: Spark, sf_dir: str) -> DataFrame:
    """Nested results as rows in order."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_type", (F.row_number().over(w) - 1).alias("idx"), "value")


@query("q2_store_report", f"WITH {sql.TRIPLES}, d AS (SELECT node, count(*) AS n FROM (SELECT subject_id AS node FROM triples UNION ALL SELECT object_id FROM triples) GROUP BY 1) SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM triples) AS triples, (SELECT max(n) FROM d) AS max_degree, (SELECT round(avg(n), 6) FROM d) AS mean_degree, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT node FROM d)) AS isolated")
def store_report(spark: Spark, sf_dir: str) -> DataFrame:
    s = built(spark, sf_dir)
    d = graph.degrees(s.triples.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")))
    isolated = s.nodes.join(d.withColumnRenamed("node", "node_id"), "node_id", "left_anti").agg(F.count("*").alias("isolated"))
    parts = [s.nodes.agg(F.count("*").alias("nodes")), s.triples.agg(F.count("*").alias("triples")), d.agg(F.max("n_total").alias("max_degree"), F.round(F.avg("n_total"), 6).alias("mean_degree")), isolated]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@query("a2_kinds_by_key", f"WITH {sql.NODES} SELECT kind, count(*) AS n, count(DISTINCT canonical_key) AS keys FROM nodes GROUP BY 1")
def kinds_by_key(spark: Spark, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("canonical_key").alias("keys"))


@query("p19_name_reasons", f"WITH {sql.NODES} SELECT node_id, unnest(list_filter([CASE WHEN length(canonical_name) <= 1 THEN 'very_short' END, CASE WHEN regexp_matches(canonical_name, '^[0-9\\s.,%-]+$') THEN 'numeric_only' END, CASE WHEN NOT regexp_matches(canonical_name, '[\\p{{L}}\\p{{N}}]') THEN 'symbol_only' END, CASE WHEN length(canonical_name) > 120 THEN 'very_long' END], lambda r: r IS NOT NULL)) AS reason FROM nodes")
def name_reasons(spark: Spark, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).nodes.select("node_id", F.explode(text.name_reasons("canonical_name")).alias("reason"))
