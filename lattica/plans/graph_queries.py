"""Graph iteration and selection queries on the graph of customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import graph, selection
from lattica.plans import sql
from lattica.plans.registry import query
from lattica.sources.tables import edges, table

Spark = SparkSession


@query("g28_transition", f"WITH {sql.EDGES}, s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), c AS (SELECT src, dst, count(*) AS c FROM s GROUP BY 1, 2) SELECT src, dst, round(c / sum(c) OVER (PARTITION BY src), 9) AS weight FROM c")
def transition(spark: Spark, sf_dir: str) -> DataFrame:
    return graph.transition(edges(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def _segment(spark: Spark, sf_dir: str, e: DataFrame, where: str) -> DataFrame:
    """The graph's customers that meet a condition, as node, with their columns."""
    customers = table(spark, sf_dir, "customer").where(where).withColumn("node", F.col("c_custkey") * 2)
    return customers.join(e.select(F.col("src").alias("node")), "node", "left_semi")


def _ppr_sql(steps: int) -> str:
    parts = [f"{sql.EDGES}, s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), c AS (SELECT src, dst, count(*) AS c FROM s GROUP BY 1, 2), m AS (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS w FROM c)", "tele AS (SELECT src AS node, 1.0 / count(*) OVER () AS p FROM (SELECT DISTINCT src FROM e JOIN customer ON src = c_custkey * 2 WHERE c_mktsegment = 'BUILDING'))", "r0 AS (SELECT node, p AS rank FROM tele)"]
    parts += [f"r{k + 1} AS (SELECT node, sum(x) AS rank FROM (SELECT dst AS node, w * rank * 0.85 AS x FROM m JOIN r{k} ON src = node UNION ALL SELECT node, p * 0.15 FROM tele) GROUP BY 1)" for k in range(steps)]
    return "WITH " + ", ".join(parts) + f" SELECT node, round(rank / (SELECT sum(rank) FROM r{steps}), 9) AS rank FROM r{steps}"


@query("g29_personalised_pagerank", _ppr_sql(4))
def pagerank(spark: Spark, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    start = _segment(spark, sf_dir, e, "c_mktsegment = 'BUILDING'").select("node").distinct()
    n = start.agg(F.count("*").alias("n"))
    tele = start.crossJoin(F.broadcast(n)).select("node", (1 / F.col("n")).alias("p"))
    return graph.personalised_pagerank(graph.transition(e), tele, 0.15, 4, 0).withColumn("rank", F.round("rank", 9))


_ORDER_GRAPH = "oe AS (SELECT o_orderkey AS eid, o_custkey * 2 AS src, c_nationkey * 2 + 1 AS dst, o_orderpriority = '1-URGENT' AS is_attribute, (o_orderstatus = 'F')::INT::DOUBLE AS lexical FROM orders JOIN customer ON o_custkey = c_custkey)"


def _step(moves: str, start: str, k: int, alpha: float = 0.15) -> str:
    return f"{start}{k + 1} AS (SELECT node, sum(x) AS rank FROM (SELECT dst AS node, w * rank * {1 - alpha} AS x FROM {moves} JOIN {start}{k} ON src = node UNION ALL SELECT node, rank * {alpha} FROM {start}0) GROUP BY 1)"


_PPR_EDGES = f"""WITH {_ORDER_GRAPH}, s1 AS (SELECT src, dst FROM oe UNION ALL SELECT dst, src FROM oe), m1 AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS w FROM s1 GROUP BY 1, 2),
  b AS (SELECT src, -1 - eid AS dst FROM oe UNION ALL SELECT dst, -1 - eid FROM oe), s2 AS (SELECT src, dst FROM b UNION ALL SELECT dst, src FROM b), m2 AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS w FROM s2 GROUP BY 1, 2),
  t AS (SELECT DISTINCT c_custkey * 2 AS node FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000), p0 AS (SELECT node, 1 / (SELECT count(*) FROM t) AS rank FROM t), q0 AS (SELECT * FROM p0), {", ".join(_step("m1", "p", k) for k in range(3))}, {", ".join(_step("m2", "q", k) for k in range(3))}
  SELECT eid, round(coalesce(a.rank, 0) / (SELECT sum(rank) FROM p3) + coalesce(z.rank, 0) / (SELECT sum(rank) FROM p3) + coalesce(o.rank, 0) / (SELECT sum(rank) FROM q3) + 0.2 * lexical + CASE WHEN is_attribute THEN 0.05 ELSE 0 END, 9) AS score
  FROM oe LEFT JOIN p3 a ON a.node = src LEFT JOIN p3 z ON z.node = dst LEFT JOIN q3 o ON o.node = -1 - eid"""


@query("g30_ppr_edge_ranking", _PPR_EDGES)
def ppr_edge_ranking(spark: Spark, sf_dir: str) -> DataFrame:
    """G28's bipartite form, G29 and G30: edges between customers and nations by the ranks of their ends and their own."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = o.select(F.col("o_orderkey").alias("eid"), (F.col("o_custkey") * 2).alias("src"), (F.col("c_nationkey") * 2 + 1).cast("long").alias("dst"), (F.col("o_orderpriority") == "1-URGENT").alias("is_attribute"), (F.col("o_orderstatus") == "F").cast("double").alias("lexical"))
    start = o.where("c_acctbal > 9000").select((F.col("o_custkey") * 2).alias("node")).distinct()
    tele = start.crossJoin(F.broadcast(start.agg(F.count("*").alias("n")))).select("node", (1 / F.col("n")).alias("p"))
    ranks = graph.personalised_pagerank(graph.transition(e), tele, 0.15, 3, 0)
    memory = graph.personalised_pagerank(graph.transition(graph.bipartite(e)), tele, 0.15, 3, 0)
    return graph.rank_edges(e, ranks, memory, 0.2, 0.05).select("eid", F.round("score", 9).alias("score"))


@query("g10_diffusion", f"""WITH {sql.EDGES}, seed AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS mass FROM e JOIN customer ON src = c_custkey * 2 WHERE c_mktsegment = 'MACHINERY'), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
  f1 AS (SELECT e.dst AS node, sum(mass) / any_value(n) AS v FROM e JOIN seed ON e.src = node JOIN i ON i.dst = e.dst GROUP BY 1),
  b1 AS (SELECT e.src AS node, sum(mass) / any_value(n) AS v FROM e JOIN seed ON e.dst = node JOIN o ON o.src = e.src GROUP BY 1)
  SELECT node, 0 AS step, mass AS forward, mass AS backward FROM seed UNION ALL SELECT coalesce(f1.node, b1.node), 1, round(coalesce(f1.v, 0), 9), round(coalesce(b1.v, 0), 9) FROM f1 FULL JOIN b1 ON f1.node = b1.node""")
def diffusion(spark: Spark, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    seed = _segment(spark, sf_dir, e, "c_mktsegment = 'MACHINERY'").select("node", F.lit(1.0).alias("mass")).distinct()
    return graph.diffusion(seed, e, 1).select("node", "step", F.round("forward", 9).alias("forward"), F.round("backward", 9).alias("backward"))


@query("g44_hop_distances", f"""WITH {sql.EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT DISTINCT c_nationkey AS qid, src AS node FROM e JOIN customer ON src = c_custkey * 2 WHERE c_acctbal > 9500), h1 AS (SELECT DISTINCT qid, dst AS node FROM h0 JOIN u ON src = node EXCEPT SELECT qid, node FROM h0),
  h2 AS (SELECT DISTINCT qid, dst AS node FROM h1 JOIN u ON src = node EXCEPT (SELECT qid, node FROM h0 UNION SELECT qid, node FROM h1)) SELECT qid, node, 0 AS hops FROM h0 UNION ALL SELECT qid, node, 1 FROM h1 UNION ALL SELECT qid, node, 2 FROM h2""")
def hop_distances(spark: Spark, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.hop_distances(_segment(spark, sf_dir, e, "c_acctbal > 9500").select(F.col("c_nationkey").alias("qid"), "node"), e, 2)


_BOTH = "n AS (SELECT n_nationkey * 2 AS i, n_regionkey * 2 + 1 AS j FROM nation UNION SELECT n_regionkey * 2 + 1, n_nationkey * 2 FROM nation UNION SELECT 1000 + c_custkey, n_nationkey * 2 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_nationkey * 2, 1000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("g47_multi_hop_adjacency", f"WITH {_BOTH}, b AS (SELECT DISTINCT x.i, y.j FROM n x JOIN n y ON x.j = y.i), c AS (SELECT DISTINCT x.i, y.j FROM b x JOIN n y ON x.j = y.i) SELECT i::BIGINT AS i, j::BIGINT AS j, round(sum(w), 6) AS weight FROM (SELECT i, j, 1.0::DOUBLE AS w FROM n UNION ALL SELECT i, j, 0.5::DOUBLE FROM b UNION ALL SELECT i, j, 0.25::DOUBLE FROM c) GROUP BY 1, 2")
def multi_hop(spark: Spark, sf_dir: str) -> DataFrame:
    """Customers, nations, regions and suppliers, nations and regions both ways: paths of up to three steps."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("long").alias("i"), (F.col("n_regionkey") * 2 + 1).cast("long").alias("j"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("i"), (F.col("c_nationkey") * 2).cast("long").alias("j"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 2).cast("long").alias("i"), (F.col("s_suppkey") + 1000000000).alias("j"))
    return graph.multi_hop_adjacency(n.union(n.select("j", "i")).union(c).union(s), 3, 0.5).withColumn("weight", F.round("weight", 6))


_Q = "qe AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS eid, l_partkey % 11 AS src, l_suppkey % 11 AS dst, l_quantity / 50.0 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def question_edges(spark: Spark, sf_dir: str) -> DataFrame:
    """A small multigraph for each customer: its order lines, as edges between eleven groups of parts and suppliers."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    eid = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lines.select(F.col("o_custkey").alias("qid"), eid.cast("long").alias("eid"), (F.col("l_partkey") % 11).alias("src"), (F.col("l_suppkey") % 11).alias("dst"), (F.col("l_quantity") / 50.0).alias("score"))


@query("j9_line_graph", f"WITH {_Q}, q AS (SELECT * FROM qe) SELECT a.qid, a.eid AS i, b.eid AS j FROM q a JOIN q b ON a.qid = b.qid AND a.dst = b.src WHERE a.eid <> b.eid")
def line_graph(spark: Spark, sf_dir: str) -> DataFrame:
    return graph.line_graph(question_edges(spark, sf_dir))


@query("a29_sinks", f"WITH {_Q} SELECT DISTINCT qid, dst AS node FROM qe WHERE (qid, dst) NOT IN (SELECT (qid, src) FROM qe)")
def sinks(spark: Spark, sf_dir: str) -> DataFrame:
    return graph.sinks(question_edges(spark, sf_dir))


@query("g14_joint_score", f"WITH {sql.EDGES}, b AS (SELECT dst, greatest(max(score), 0) AS best FROM e GROUP BY 1) SELECT l_orderkey, l_linenumber, round(score + 0.2 * (e.dst % 7 / 7.0) - 0.1 * (e.src % 7 / 7.0) - 0.05 * (e.src % 7 / 7.0) * coalesce(best, 0), 6) AS score FROM e LEFT JOIN b ON b.dst = e.src")
def joint_score(spark: Spark, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumnRenamed("score", "edge_score")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("end_score", F.col("node") % 7 / 7.0)
    return graph.joint_score(e, nodes, 0.2, 0.1, 0.05).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query("w12_rank_prizes", f"WITH {_Q} SELECT qid, eid, greatest(6 - row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid), 0) AS prize FROM qe")
def rank_prizes(spark: Spark, sf_dir: str) -> DataFrame:
    return graph.rank_prizes(question_edges(spark, sf_dir), 5, ["qid"]).select("qid", "eid", "prize")


@query("u7_block_diagonal", f"WITH {_Q}, q AS (SELECT * FROM qe), s AS (SELECT qid, max(eid) AS n FROM q GROUP BY 1), o AS (SELECT qid, coalesce(sum(n) OVER (ORDER BY qid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM s) SELECT a.eid + o AS i, b.eid + o AS j, round(a.score * b.score, 6) AS w FROM q a JOIN q b ON a.qid = b.qid AND a.dst = b.src JOIN o ON o.qid = a.qid WHERE a.eid <> b.eid")
def block_diagonal(spark: Spark, sf_dir: str) -> DataFrame:
    q = question_edges(spark, sf_dir)
    score = lambda side: q.select("qid", F.col("eid").alias(side), F.col("score").alias(f"s_{side}"))
    adj = graph.line_graph(q).join(score("i"), ["qid", "i"]).join(score("j"), ["qid", "j"]).withColumn("w", F.round(F.col("s_i") * F.col("s_j"), 6))
    return graph.block_diagonal(adj, q.groupBy("qid").agg(F.max("eid").alias("n")))


def _topics(e: DataFrame) -> DataFrame:
    return e.groupBy("qid").agg(F.min("src").alias("node"))


@query("g15_build_dag")
def build_dag(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    budget = selection.Budget()
    return selection.per_question(e, _topics(e), lambda own, topics: selection.build_dag(own, topics, budget))


_GREEDY = f"""WITH RECURSIVE {_Q}, r AS (SELECT qid, eid, src, dst, row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid) AS k FROM qe),
  go(qid, k, reach, kept) AS (SELECT DISTINCT qid, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM qe UNION ALL
    SELECT go.qid, r.k, CASE WHEN src = dst OR list_contains(reach, dst * 100 + src) THEN reach ELSE list_distinct(list_concat(reach, flatten(
      [[a * 100 + b FOR b IN list_concat([dst], [x % 100 FOR x IN reach IF x // 100 = dst])] FOR a IN list_concat([src], [x // 100 FOR x IN reach IF x % 100 = src])]))) END,
      CASE WHEN src = dst OR list_contains(reach, dst * 100 + src) THEN kept ELSE list_append(kept, eid) END
    FROM go JOIN r ON r.qid = go.qid AND r.k = go.k + 1),
  last AS (SELECT qid, arg_max(kept, k) AS kept FROM go GROUP BY qid) SELECT qe.* FROM qe JOIN last USING (qid) WHERE list_contains(kept, eid)"""


@query("g16_without_cycles", _GREEDY)
def without_cycles(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, _: selection.without_cycles(own))


@query("g17_weakest_off_cycles")
def weakest_off_cycles(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, _: selection.weakest_off_cycles(own))


@query("g21_limit_terminals")
def limit_terminals(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: selection.limit_terminals(own, topics, 3))


@query("g22_reverse_beam")
def reverse_beam(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: selection.reverse_beam(own, selection.build_dag(own, topics, selection.Budget()), 3, 4, 3, 24, 24))


@query("g32_forward_beam")
def forward_beam(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: selection.forward_beam(own, topics, 3, 3, 24))


@query("y3_hard_negatives", f"WITH {_Q}, a AS (SELECT DISTINCT qid, dst FROM qe WHERE score > 0.95) SELECT q.qid, eid FROM qe q JOIN a ON a.qid = q.qid AND q.src = a.dst WHERE (q.qid, q.dst) NOT IN (SELECT (qid, dst) FROM a)")
def hard_negatives(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    a = e.where("score > 0.95").select("qid", F.col("dst").alias("node")).distinct()
    out = e.join(a.withColumnRenamed("node", "src"), ["qid", "src"], "left_semi")
    return out.join(a.withColumnRenamed("node", "dst"), ["qid", "dst"], "left_anti").select("qid", "eid")


@query("j20_supporting_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def supporting_filter(spark: Spark, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(keep, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")
