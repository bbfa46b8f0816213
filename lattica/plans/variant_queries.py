"""Queries of variants: scores and prizes of nodes and edges, silver paths, swaps, fills, edit rounds, cumulative graphs, noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import phrases
from lattica.operators import graph, reports, retrieval, selection, variants
from lattica.plans import sql
from lattica.plans.graph_queries import _Q, _topics, question_edges
from lattica.plans.registry import query
from lattica.sources import tables
from lattica.sources.tables import table

Spark = SparkSession


@query("g11_edge_scalars", f"WITH {sql.EDGES}, i AS (SELECT dst, count(*) AS n, sum(CAST(score AS DECIMAL(28, 10)))::DOUBLE / count(score) AS m FROM e GROUP BY 1), o AS (SELECT src, count(*) AS n, max(score) AS m FROM e GROUP BY 1) SELECT l_orderkey, l_linenumber, e.src, e.dst, round(e.score / o.m, 6) AS of_best, round(e.score - i.m, 6) AS over_mean, round(1 / o.n, 6) AS out_share, round(ln(1 + i.n), 6) AS log_in FROM e JOIN i ON i.dst = e.dst JOIN o ON o.src = e.src")
def edge_scalars(spark: Spark, sf_dir: str) -> DataFrame:
    """Scalars of each edge from its score and its ends' degrees."""
    s = variants.edge_scalars(tables.edges(spark, sf_dir))
    return s.select("l_orderkey", "l_linenumber", "src", "dst", *[F.round(c, 6).alias(c) for c in ("of_best", "over_mean", "out_share", "log_in")])


@query("g12_linear_scores", f"WITH {sql.EDGES}, i AS (SELECT dst, sum(CAST(score AS DECIMAL(28, 10)))::DOUBLE / count(score) AS m FROM e GROUP BY 1), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1) SELECT l_orderkey, l_linenumber, e.src, e.dst, 0.0 + 0.65 * score + 0.2 * (score - i.m) + 0.15 * (1 / o.n) AS linear, round(1 / (1 + exp(-(0.0 + 0.65 * score + 0.2 * (score - i.m) + 0.15 * (1 / o.n)))), 6) AS chance FROM e JOIN i ON i.dst = e.dst JOIN o ON o.src = e.src")
def linear_scores(spark: Spark, sf_dir: str) -> DataFrame:
    """A weighted sum of scalars, and its logistic."""
    s = variants.edge_scalars(tables.edges(spark, sf_dir))
    total = variants.linear({"score": 0.65, "over_mean": 0.2, "out_share": 0.15})
    return s.select("l_orderkey", "l_linenumber", "src", "dst", total.alias("linear"), F.round(1 / (1 + F.exp(-total)), 6).alias("chance"))


@query("g13_scorer")
def scorer(spark: Spark, sf_dir: str) -> DataFrame:
    """A small network over the scalars, its weights broadcast as a checkpoint's are."""
    s = variants.edge_scalars(tables.edges(spark, sf_dir))
    return variants.network_scores(s, ["score", "of_best", "over_mean", "out_share"], variants.made_network(4, 8, 5)).select("l_orderkey", "l_linenumber", "src", "dst", "chance")


@query("g27_all_edges", f"WITH {_Q} SELECT qid, count(*) AS n, count(DISTINCT src) AS sources, 0 AS n_adj FROM qe GROUP BY 1")
def all_edges(spark: Spark, sf_dir: str) -> DataFrame:
    """The baseline that keeps every edge and links none."""
    return question_edges(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.lit(0).alias("n_adj"))


@query("g34_prize_problem", f"""WITH {_Q}, r AS (SELECT *, greatest(6 - row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid), 0) AS prize FROM qe)
  SELECT qid, eid, src, dst, round(2.5 - prize, 6) AS cost, 0.0 AS prize FROM r WHERE prize <= 2.5 UNION ALL SELECT qid, eid, src, -1 - eid, 0.0, prize - 2.5 FROM r WHERE prize > 2.5 UNION ALL SELECT qid, eid, -1 - eid, dst, 0.0, prize - 2.5 FROM r WHERE prize > 2.5""")
def prize_problem(spark: Spark, sf_dir: str) -> DataFrame:
    """Edges cost what their prize leaves; one whose prize is above the cost becomes a node of its own with the rest as its prize."""
    return variants.prize_problem(graph.rank_prizes(question_edges(spark, sf_dir), 5, ["qid"]), 2.5)


@query("y4_node_prizes", f"""WITH {_Q}, x AS (SELECT qid, src AS node, score FROM qe UNION ALL SELECT qid, dst, score FROM qe), d AS (SELECT qid, node, count(*) AS n, max(score) AS best FROM x GROUP BY 1, 2)
  SELECT qid, node, round(node / 11.0 + CASE WHEN node = 3 THEN 1.2 ELSE 0 END + 0.5 * best + 0.15 * least(1, ln(1 + n) / ln(6)) - CASE WHEN node > 8 THEN 0.15 ELSE 0 END, 6) AS prize FROM d""")
def node_prizes(spark: Spark, sf_dir: str) -> DataFrame:
    """Similarity, mention, best edge, degree, and less for values."""
    node = F.col("node")
    return variants.node_prizes(question_edges(spark, sf_dir), node / 11.0, node == 3, node > 8).select("qid", "node", F.round("prize", 6).alias("prize"))


@query("g50_path_chains", "WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS j, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, j - 1 AS i, j FROM p WHERE j < n")
def path_chains(spark: Spark, sf_dir: str) -> DataFrame:
    """Each step of a path leads to the next one."""
    return variants.path_chains(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


_ROUND = "rd AS (SELECT c_nationkey AS qid, floor(o_orderkey / 1000)::BIGINT AS round, o_orderkey AS eid, o_custkey AS src, c_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("g51_cumulative_graphs", f"WITH {_ROUND}, n AS (SELECT qid, round, count(*) AS n FROM rd GROUP BY 1, 2) SELECT t.qid, t.round, sum(b.n)::BIGINT AS n_nodes, max(b.round) AS last, sum(b.n) FILTER (b.round < t.round)::BIGINT AS before FROM n t JOIN n b ON b.qid = t.qid AND b.round <= t.round GROUP BY 1, 2")
def cumulative_graphs(spark: Spark, sf_dir: str) -> DataFrame:
    """Each round with all rounds before it; where each round's own nodes begin."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy(F.col("c_nationkey").alias("qid"), F.floor(F.col("o_orderkey") / 1000).alias("round")).agg(F.count("*").alias("n"))
    return variants.cumulative(n, "qid", "round", "n")


@query("g49_reversed_noise")
def reversed_noise(spark: Spark, sf_dir: str) -> DataFrame:
    """A tenth of the edges of acyclic graphs turned round, each only if the graph stays acyclic."""
    e = question_edges(spark, sf_dir)
    kept = selection.per_question(e, _topics(e), lambda own, _: selection.without_cycles(own))
    return selection.rewritten(kept, lambda own: selection.reversed_noise(own, 0.1, lambda x: (x.eid * 2654435761) % 2**32))


@query("y10_silver_paths", "WITH p AS (SELECT l_orderkey, l_returnflag || l_linestatus AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place FROM lineitem), s AS (SELECT l_orderkey, arg_min(place, (CASE WHEN text = 'RF' THEN 0 ELSE 1 END, place)) AS silver FROM p WHERE contains(text, 'R') GROUP BY 1) SELECT p.l_orderkey, text, place, CASE WHEN silver IS NULL THEN place WHEN place = 0 THEN silver WHEN place = silver THEN 0 ELSE place END AS swapped FROM p LEFT JOIN s USING (l_orderkey)")
def silver_paths(spark: Spark, sf_dir: str) -> DataFrame:
    """The first path that is the answer, else the first that holds it, changes places with the first."""
    p = table(spark, sf_dir, "lineitem").withColumn("text", F.concat("l_returnflag", "l_linestatus"))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1)
    return variants.silver_first(p, "l_orderkey", F.col("text") == "RF", F.contains("text", F.lit("R"))).select("l_orderkey", "text", "place", "swapped")


@query("y7_paired_stages", "WITH f AS (SELECT l_orderkey AS title, l_linenumber AS triple_id, min(l_partkey) AS forward FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), r AS (SELECT l_orderkey AS title, l_linenumber AS triple_id, min(l_suppkey) AS backward FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) SELECT f.title, f.triple_id, forward, coalesce(backward, -1) AS backward FROM f LEFT JOIN r USING (title, triple_id)")
def paired_stages(spark: Spark, sf_dir: str) -> DataFrame:
    """Valid forward items with the reverse item of their title and triple; a missing one is empty."""
    line = table(spark, sf_dir, "lineitem")
    side = lambda where, c, name: line.where(where).groupBy(F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("triple_id")).agg(F.min(c).alias(name))
    return side("l_returnflag != 'N'", "l_partkey", "forward").join(side("l_linestatus = 'F'", "l_suppkey", "backward"), ["title", "triple_id"], "left").fillna(-1, ["backward"])


@query("y8_mapped_relations", f"""WITH m AS (SELECT p_partkey, lower(p_type) AS raw FROM part), x AS (SELECT p_partkey, CASE {" ".join(f"WHEN contains(raw, '{a}') THEN '{b}'" for a, b in variants.RELATION_SYNONYMS)} ELSE raw END AS relation FROM m) SELECT p_partkey, relation FROM x WHERE len(string_split(relation, ' ')) <= 6 AND relation NOT IN ({", ".join(f"'{w}'" for w in variants.WEAK_RELATIONS)})""")
def mapped_relations(spark: Spark, sf_dir: str) -> DataFrame:
    """Relation phrases brought to one name; weak and long ones go."""
    return variants.mapped_relations(table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("relation")))


@query("q19_edit_rounds", "WITH r AS (SELECT p_partkey, p_brand, round, ('0x' || substr(md5(p_partkey || '-' || round), 1, 8))::BIGINT AS h FROM part, unnest([1, 2, 3]) AS t(round)), k AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY h, p_partkey) AS n FROM r) SELECT p_partkey, round, ['attribute_update', 'attribute_insert', 'relation_update', 'relation_insert'][h % 4 + 1] AS edit_type, p_brand || ' revised r' || round AS new_answer, 'What is the brand of Part ' || p_partkey || '?' AS question FROM k WHERE n <= 100")
def edit_rounds(spark: Spark, sf_dir: str) -> DataFrame:
    """In each round a hundred samples, picked by hash, get an edit of a type and a new answer."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("answer"))
    e = variants.edit_rounds(p, "key", 3, 100)
    return e.select(F.col("key").alias("p_partkey"), "round", "edit_type", F.concat("answer", F.lit(" revised r"), F.col("round").cast("string")).alias("new_answer"), F.concat(F.lit("What is the brand of Part "), F.col("key").cast("string"), F.lit("?")).alias("question"))


@query("q20_repeated_edits", "WITH r AS (SELECT p_partkey, round, ('0x' || substr(md5(p_partkey || '-' || round), 1, 8))::BIGINT AS h FROM part, unnest([1, 2, 3]) AS t(round)), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY round ORDER BY h, p_partkey) <= 100), c AS (SELECT p_partkey, count(*) AS n FROM k GROUP BY 1) SELECT n AS bucket, count(*) AS samples FROM c GROUP BY 1")
def repeated_edits(spark: Spark, sf_dir: str) -> DataFrame:
    e = variants.edit_rounds(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), "key", 3, 100)
    return e.groupBy("key").agg(F.count("*").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("samples"))


@query("q25_merged_datasets", "WITH d AS (SELECT doc_id AS id, 0 AS ds, lang, text, n_chars FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 1, lang, text, n_chars FROM documents WHERE n_chars > 300), a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_chars DESC, ds) = 1) SELECT id, ds FROM a QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY id) = 1")
def merged_datasets(spark: Spark, sf_dir: str) -> DataFrame:
    """The best sample of each id over two data sets, then one of each content."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    both = d.where("source is not null").withColumn("ds", F.lit(0)).union(d.where("n_chars > 300").withColumn("ds", F.lit(1)))
    best = reports.best_of(both, "id", ["n_chars"], "ds")
    return reports.keep_first(best.withColumn("fp", reports.content_key(best.select("lang", "text"), [])), ["fp"], ["id"]).select("id", "ds")


@query("q34_training_edges", f"WITH {_Q}, a AS (SELECT *, score > 0.9 AS label FROM qe), s AS (SELECT DISTINCT qid, dst FROM a WHERE label), n AS (SELECT a.*, (a.qid, a.src) IN (SELECT (qid, dst) FROM s) AS hard FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score + CASE WHEN hard THEN 5 ELSE 0 END DESC, eid) AS rank FROM n) SELECT qid, eid, label, hard FROM r WHERE label OR rank <= 4")
def training_edges(spark: Spark, sf_dir: str) -> DataFrame:
    """Edges that match the answer, and of the others the best four, those that leave an answer first."""
    return variants.training_edges(question_edges(spark, sf_dir).withColumn("label", F.col("score") > 0.9), 4).select("qid", "eid", "label", "hard")


@query("q38_distinct_entities", "SELECT l.n_name AS nation, count(DISTINCT c_mktsegment) AS titles, count(DISTINCT c_custkey) AS entities FROM customer JOIN nation l ON c_nationkey = n_nationkey GROUP BY 1")
def distinct_entities(spark: Spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("nation")).agg(F.count_distinct("c_mktsegment").alias("titles"), F.count_distinct("c_custkey").alias("entities"))


@query("s15_tensor_gather", "WITH asked AS (SELECT vec_id AS qid, unnest([vec_id, 3, vec_id, 0]) AS kv_offset, unnest([0, 1, 2, 3]) AS pos FROM embeddings WHERE label = 1) SELECT qid, pos, kv_offset, round(list_sum(embedding), 3) AS total FROM asked JOIN embeddings ON vec_id = kv_offset")
def tensor_gather(spark: Spark, sf_dir: str) -> DataFrame:
    """Vectors by offset, in the order asked for, repeats included."""
    from lattica.operators.store import fetch_in_order

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("kv_offset"), "embedding")
    asked = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("qid"), F.array("vec_id", F.lit(3).cast("long"), "vec_id", F.lit(0).cast("long")).alias("keys"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return fetch_in_order(asked, v).select("qid", "pos", "kv_offset", F.round(total, 3).alias("total"))


@query("s16_appended_tensors", "WITH m AS (SELECT max(vec_id) AS m FROM embeddings) SELECT vec_id AS kv_offset, len(embedding)::INT AS n FROM embeddings UNION ALL SELECT m + row_number() OVER (ORDER BY vec_id), len(embedding)::INT FROM embeddings, m WHERE label = 1")
def appended_tensors(spark: Spark, sf_dir: str) -> DataFrame:
    """Vectors appended behind the last offset; another length is an error."""
    v = table(spark, sf_dir, "embeddings")
    have = v.select(F.col("vec_id").alias("kv_offset"), "embedding")
    return variants.append_vectors(have, v.where("label = 1").select("vec_id", "embedding"), "vec_id").select("kv_offset", F.size("embedding").alias("n"))


@query("y14_insert_positions", "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), t AS (SELECT DISTINCT l_orderkey, n, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % (n + 1) AS at_ FROM c) SELECT c.l_orderkey, l_partkey, CASE WHEN place >= at_ THEN place + 1 ELSE place END AS place FROM c JOIN t USING (l_orderkey) UNION ALL SELECT l_orderkey, -1, at_ FROM t")
def insert_positions(spark: Spark, sf_dir: str) -> DataFrame:
    """A true row put among others at a place that a hash gives; those behind move on."""
    line = table(spark, sf_dir, "lineitem")
    c = line.select("l_orderkey", "l_partkey", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1).cast("long").alias("place"))
    return variants.inserted(c, "l_orderkey", "l_partkey", -1)


@query("q12_graph_metrics", f"""WITH {_Q}, n AS (SELECT qid, src AS node FROM qe UNION SELECT qid, dst FROM qe), s AS (SELECT qid, count(*) AS sinks FROM n WHERE (qid, node) NOT IN (SELECT (qid, src) FROM qe) GROUP BY 1)
  SELECT qid, count(*) AS edges, any_value(nn) AS nodes, coalesce(any_value(sinks), 0) AS sinks, sum(CAST(score AS DECIMAL(28, 10)))::DOUBLE / count(score) AS relevance, count(*) / (any_value(nn) * (any_value(nn) - 1) + 1) AS density FROM qe JOIN (SELECT qid, count(*) AS nn FROM n GROUP BY 1) USING (qid) LEFT JOIN s USING (qid) GROUP BY qid""")
def graph_metrics(spark: Spark, sf_dir: str) -> DataFrame:
    """Q12, Q13, Q39: size, sinks, relevance and density of each question's graph."""
    return variants.graph_metrics(question_edges(spark, sf_dir))


@query("g45_relation_paths")
def relation_paths(spark: Spark, sf_dir: str) -> DataFrame:
    """The first shortest way, of at most four steps in any direction, from the first node to the last."""
    return variants.relation_paths(question_edges(spark, sf_dir), 4)


@query("q36_question_templates", "SELECT s_suppkey, 'the balance of ' || s_name || ' is' AS key_text FROM supplier")
def question_templates(spark: Spark, sf_dir: str) -> DataFrame:
    """Q36: keys of synthetic rows by template."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("the %s of %s is", F.lit("balance"), phrases.text_of("s_name")).alias("key_text"))


@query("g31_connected_first")
def connected_first(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: variants.connected_first(own, topics, 16))


@query("g33_two_way_beam")
def two_way_beam(spark: Spark, sf_dir: str) -> DataFrame:
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, _: variants.two_way_beam(own, 2, 3, 3, 16))


@query("g35_steiner_edges")
def steiner_edges(spark: Spark, sf_dir: str) -> DataFrame:
    """The cheapest tree over the first, the last and the best scored nodes, turned away from the first."""
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: variants.steiner_edges(own, topics, 3))


@query("g39_group_steiner")
def group_steiner(spark: Spark, sf_dir: str) -> DataFrame:
    """The cheapest tree that touches each group of anchors."""
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: variants.group_steiner(own, [set(topics), {1, 2}, {9, 10}]))


@query("g23_answers_at_ends")
def answers_at_ends(spark: Spark, sf_dir: str) -> DataFrame:
    """Answers have no out-edges but those that another answer needs to be reached."""
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: variants.answers_at_ends(own, topics, {1, 5}))


@query("g25_attached_answers")
def attached_answers(spark: Spark, sf_dir: str) -> DataFrame:
    """An answer without in-edges gets its best one, in the place of the worst edge where the graph is full."""
    e = question_edges(spark, sf_dir)
    budget = selection.Budget()
    return selection.per_question(e, _topics(e), lambda own, topics: variants.attach_answers(own, selection.build_dag(own, topics, budget), {1, 5}, budget.max_edges))


@query("g41_iterative_retrieval")
def iterative_retrieval(spark: Spark, sf_dir: str) -> DataFrame:
    """Step by step the best edge that leaves what is there, scored anew by the last three edges."""
    e = question_edges(spark, sf_dir)
    return selection.per_question(e, _topics(e), lambda own, topics: variants.iterative(own, topics, 6, 0.2))


@query("q7_question_graphs")
def question_graphs(spark: Spark, sf_dir: str) -> DataFrame:
    """From the candidate edges of a question to the exported graph, by a strategy chosen by name."""
    e = question_edges(spark, sf_dir)
    kept = selection.per_question(e, _topics(e), variants.STRATEGIES["budgeted"])
    out = retrieval.exported(kept)
    return out.select("qid", F.size("kv_nodes").alias("n_nodes"), F.size("adj").alias("n_adj"))
