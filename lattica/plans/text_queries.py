"""Text, dataset, metric and edit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.functions.vectors import hash_embedder
from lattica.operators import metrics
from lattica.plans import sql
from lattica.plans.registry import query
from lattica.sources import responses
from lattica.sources.files import not_done, parquet_preview
from lattica.sources.tables import table

Spark = SparkSession


@query("f1_content_hash", f"SELECT c_custkey, {sql.digest('c_name', 'c_mktsegment')} AS content_key, md5(c_name) AS md5, substr(sha256(c_name), 1, 10) AS short FROM customer")
def content_hash(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.content_hash("c_name", "c_mktsegment").alias("content_key"), F.md5("c_name").alias("md5"), F.substring(F.sha2("c_name", 256), 1, 10).alias("short"))


@query("n1_canonical_keys", f"SELECT p_partkey, {sql.key('p_name')} AS k FROM part UNION ALL SELECT s_suppkey + 100000000, {sql.key('s_name')} FROM supplier")
def canonical_keys(spark: Spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", text.canonical_entity_key("p_name").alias("k"))
    return part.union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 100000000, text.canonical_entity_key("s_name")))


@query("n2_lexical_jaccard", f"WITH p AS (SELECT p_partkey, {sql.lex('p_name')} AS a, {sql.lex('p_type')} AS b FROM part) SELECT p_partkey, array_to_string(a, ' ') AS lex, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS j FROM p")
def lexical_jaccard(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_lex("p_name").alias("lex"), F.round(text.jaccard("p_name", "p_type"), 6).alias("j"))


@query("p16_attribute_like", "SELECT p_partkey, p_type LIKE '%[0-9]%' OR regexp_matches(p_type, '[0-9]') OR (len(string_split(trim(p_type), ' ')) <= 2 AND p_type = lower(p_type) AND p_type <> '') AS is_attribute FROM part")
def attribute_like(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.is_attribute_like(F.lit("RELATION"), F.col("p_type")).alias("is_attribute"))


@query("f17_sentence_counts", r"SELECT conv_id, turn, len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n FROM conversations")
def sentence_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.sentences("text")).cast("long").alias("n"))


@query("f18_numbers", r"SELECT event_id, array_to_string(regexp_extract_all(props, '\b([0-9]+(?:\.[0-9]+)?)\b', 1), ',') AS found FROM events")
def numbers(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.numbers("props"), ",").alias("found"))


@query("s7_parquet_preview", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 25")
def preview(spark: Spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").count()
    return parquet_preview(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_brand"], n).orderBy("p_partkey").limit(25)


@query("s20_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark: Spark, sf_dir: str) -> DataFrame:
    return not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("s22_pairs_or_text", "SELECT conv_id, turn, coalesce(nullif(text, ''), role) AS key_text FROM conversations")
def pairs_or_text(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.nullif("text", F.lit("")), "role").alias("key_text"))


_LOG = "CASE WHEN event_type = 'error' THEN '=== run ' || event_id ELSE 'step ' || event_id || ' ' || event_type || ' loss=' || value END"


@query("s24_log_metrics", f"WITH l AS (SELECT event_id, {_LOG} AS line FROM events), x AS (SELECT *, sum(starts_with(line, '=== run')::INT) OVER (ORDER BY event_id) AS part FROM l) SELECT part::BIGINT AS part, event_id, regexp_extract(line, 'click loss=(-?[0-9.]+)', 1)::DOUBLE AS metric FROM x WHERE regexp_extract(line, 'click loss=(-?[0-9.]+)', 1) <> ''")
def log_metrics(spark: Spark, sf_dir: str) -> DataFrame:
    """Lines of a log cut into runs at a marker, and a metric read from the lines that hold it."""
    from lattica.sources.files import log_values

    key, value = F.col("event_id").cast("string"), F.col("value").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("=== run "), key)).otherwise(F.concat(F.lit("step "), key, F.lit(" "), "event_type", F.lit(" loss="), value))
    return log_values(table(spark, sf_dir, "events").select("event_id", line.alias("value")), "=== run", "click loss=(-?[0-9.]+)", "event_id")


_ANSWERS = "WITH a AS (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations QUALIFY g IS NOT NULL AND text IS NOT NULL)"


def _answers(spark: Spark, sf_dir: str) -> DataFrame:
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("p"), nxt.alias("g")).where("g is not null and p is not null")


@query("f8_exact_match", f"{_ANSWERS} SELECT conv_id, turn, ({sql.answer('p')} = {sql.answer('g')})::DOUBLE AS em FROM a")
def exact_match(spark: Spark, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", metrics.exact_match("p", "g").alias("em"))


_WORDS = f"list_filter(string_split({sql.answer('p')}, ' '), lambda w: w <> '') AS pw, list_filter(string_split({sql.answer('g')}, ' '), lambda w: w <> '') AS gw"


@query(
    "f8_token_f1",
    f"""{_ANSWERS}, w AS (SELECT conv_id, turn, {_WORDS} FROM a), pc AS (SELECT conv_id, turn, x, count(*) AS c FROM (SELECT conv_id, turn, unnest(pw) AS x FROM w) GROUP BY ALL), gc AS (SELECT conv_id, turn, x, count(*) AS c FROM (SELECT conv_id, turn, unnest(gw) AS x FROM w) GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(pc.c, gc.c)) AS same FROM pc JOIN gc USING (conv_id, turn, x) GROUP BY ALL)
    SELECT conv_id, turn, round(CASE WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = len(gw))::DOUBLE ELSE coalesce(2 * same / (len(pw) + len(gw)), 0) END, 6) AS f1 FROM w LEFT JOIN s USING (conv_id, turn)""",
)
def token_f1(spark: Spark, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1("p", "g"), 6).alias("f1"))


@query("f9_rouge_l")
def rouge_l(spark: Spark, sf_dir: str) -> DataFrame:
    """words as answers are compared; each text is cut into words once."""
    cut = _answers(spark, sf_dir).select("conv_id", "turn", metrics.words("p").alias("p"), metrics.words("g").alias("g"))
    scored = cut.select("conv_id", "turn", metrics.rouge("p", "g").alias("r"))
    return scored.select("conv_id", "turn", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("rouge1", "rouge2", "rouge_l")])


@query("f9_rouge_stemmed")
def rouge_stemmed(spark: Spark, sf_dir: str) -> DataFrame:
    """ROUGE over stems."""
    a = _answers(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min("p").alias("p"), F.min("g").alias("g"))
    return metrics.rouge_stemmed(a, ["conv_id", "turn"], "p", "g")


@query("f10_faithfulness")
def faithfulness(spark: Spark, sf_dir: str) -> DataFrame:
    """Cosine of the embeddings of answer and reference, here of hashed words."""
    found = metrics.embedding_faithfulness(_answers(spark, sf_dir), "p", "g", hash_embedder(64))
    return found.select("conv_id", "turn", F.round("faithfulness", 5).alias("faithfulness"))


@query("p12_mended_responses")
def mended_responses(spark: Spark, sf_dir: str) -> DataFrame:
    """The events' JSON as a model would give it, fenced or cut off by length; what is read of it in how many attempts, and dead letters."""
    props = F.coalesce("props", F.lit(""))
    said = F.when(F.length(props) % 3 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(F.length(props) % 3 == 1, F.substring(props, F.lit(1), F.length(props) - 2)).otherwise(props)
    good, dead = responses.read_responses(table(spark, sf_dir, "events").select("event_id", said.alias("said")), "said")
    return good.select("event_id", "attempts", F.to_json("parsed").alias("json"), F.lit(None).cast("string").alias("why")).union(dead.select("event_id", "attempts", F.lit(None).cast("string"), "why"))


@query("q32_passage_recall", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
  s AS (SELECT q.vec_id AS qid, v.vec_id, v.label = q.label AS same, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s),
  g AS (SELECT qid, count(*) FILTER (same) AS gold, count(*) FILTER (same AND rank <= 10) AS found FROM r GROUP BY 1) SELECT qid, round(found / gold, 6) AS recall, (found > 0)::INT AS hit, (found = gold)::INT AS all_hit FROM g""")
def passage_recall(spark: Spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors against all of the query's label."""
    from lattica.operators.search import top_k

    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label"))
    hits = top_k(asked.select("qid", "vector"), v.select(F.col("vec_id").alias("node_id"), "embedding"), 10).groupBy("qid").agg(F.collect_set("node_id").alias("found"))
    gold = asked.select("qid", "label").join(v.select("label", "vec_id"), "label").groupBy("qid").agg(F.collect_set("vec_id").alias("gold"))
    recall, hit, all_hit = metrics.retrieval(F.col("found"), F.col("gold"))
    return gold.join(hits, "qid").select("qid", recall, hit, all_hit).withColumn("recall", F.round("recall", 6))


@query("w1_running_offsets", "SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_id, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def running_offsets(spark: Spark, sf_dir: str) -> DataFrame:
    from lattica.operators.windows import exclusive_offsets

    return exclusive_offsets(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n", "start_id")


@query("w4_rank_change", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank_before, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank_after FROM lineitem) SELECT *, rank_before - rank_after AS rose FROM r")
def rank_change(spark: Spark, sf_dir: str) -> DataFrame:
    return metrics.rank_change(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "rank_before", "rank_after", "rose")


@query("w6_answer_rank_hits", "WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rank, l_returnflag = 'R' AS is_answer FROM lineitem) SELECT l_orderkey, min(rank) AS best, (min(rank) <= 3)::INT AS top3 FROM r WHERE is_answer GROUP BY 1")
def answer_rank_hits(spark: Spark, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    return r.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("rank").alias("best")).withColumn("top3", (F.col("best") <= 3).cast("int"))


@query("w8_per_source_cap", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def per_source_cap(spark: Spark, sf_dir: str) -> DataFrame:
    from lattica.operators.graph import per_source_cap as cap

    return cap(table(spark, sf_dir, "orders"), 3, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("w11_cdf", "SELECT s_nationkey, s_suppkey, round(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) / count(*) OVER (PARTITION BY s_nationkey), 6) AS y FROM supplier")
def cdf(spark: Spark, sf_dir: str) -> DataFrame:
    return metrics.cdf(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"], "s_suppkey").select("s_nationkey", "s_suppkey", F.round("y", 6).alias("y"))


@query("a11_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def percentiles(spark: Spark, sf_dir: str) -> DataFrame:
    out = metrics.summary(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "p50", "p95", "p99", "most", "std")])


@query("a26_best_pair_cost", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, round(min(greatest(0.02, 1.25 - l_discount + 0.1)), 6) AS cost FROM lineitem GROUP BY 1, 2")
def best_pair_cost(spark: Spark, sf_dir: str) -> DataFrame:
    from lattica.operators.graph import edge_cost

    cost = F.min(edge_cost(F.col("l_discount"), F.lit(True)))
    return table(spark, sf_dir, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.round(cost, 6).alias("cost"))


_ROUNDS = "WITH r AS (SELECT user_id, CAST(floor(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) / 7) AS BIGINT) AS round, event_type AS answer, event_id FROM events), one AS (SELECT user_id, round, arg_min(answer, event_id) AS answer FROM r GROUP BY 1, 2)"


def _rounds(spark: Spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.agg(F.to_date(F.min("ts")).alias("first"))
    days = e.crossJoin(F.broadcast(first)).withColumn("round", F.floor(F.date_diff(F.to_date("ts"), F.col("first")) / 7))
    return days.groupBy("user_id", "round").agg(F.min_by("event_type", "event_id").alias("answer"))


@query("j17_cumulative_rounds", f"{_ROUNDS} SELECT t.user_id, t.round, count(*) AS n_before, count(DISTINCT b.answer) AS n_answers FROM one t JOIN one b ON b.user_id = t.user_id AND b.round <= t.round GROUP BY 1, 2")
def cumulative_rounds(spark: Spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return _rounds(spark, sf_dir).select("user_id", "round", F.count("*").over(w).alias("n_before"), F.size(F.collect_set("answer").over(w)).cast("long").alias("n_answers"))


@query("j18_seen_before", f"{_ROUNDS} SELECT t.user_id, t.round, bool_or(b.answer = t.answer) AS seen FROM one t LEFT JOIN one b ON b.user_id = t.user_id AND b.round < t.round GROUP BY 1, 2 HAVING count(b.round) > 0")
def seen_before(spark: Spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    r = _rounds(spark, sf_dir).withColumn("former", F.collect_set("answer").over(w))
    return r.where(F.size("former") > 0).select("user_id", "round", F.array_contains("former", F.col("answer")).alias("seen"))


@query(
    "a34_round_transitions",
    f"""{_ROUNDS}, g AS (SELECT user_id, round, answer, 'purchase' AS gold FROM one), b AS (SELECT * FROM g WHERE round = 0), t AS (SELECT * FROM g WHERE round = 1)
    SELECT count(*) AS shared, coalesce(sum((b.answer = b.gold AND t.answer = t.gold)::INT), 0)::BIGINT AS stayed_right, coalesce(sum((b.answer = b.gold AND t.answer <> t.gold)::INT), 0)::BIGINT AS lost,
      coalesce(sum((b.answer <> b.gold AND t.answer = t.gold)::INT), 0)::BIGINT AS gained, coalesce(sum((b.answer <> b.gold AND t.answer <> t.gold)::INT), 0)::BIGINT AS stayed_wrong, coalesce(sum((t.answer <> t.gold AND t.answer = b.gold)::INT), 0)::BIGINT AS stale
    FROM b JOIN t USING (user_id)""",
)
def round_transitions(spark: Spark, sf_dir: str) -> DataFrame:
    r = _rounds(spark, sf_dir).select("user_id", "round", F.col("answer").alias("prediction"), F.lit("purchase").alias("gold"))
    return metrics.transitions(r.where("round = 0"), r.where("round = 1"), "user_id")


@query("a35_edit_buckets", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT least(n, 20) AS bucket, count(*) AS users FROM c GROUP BY 1), f AS (SELECT *, max((users < 5)::INT) OVER (ORDER BY bucket) AS small FROM b) SELECT CASE WHEN small = 1 THEN -1 ELSE bucket END AS bucket, sum(users)::BIGINT AS users FROM f GROUP BY 1")
def edit_buckets(spark: Spark, sf_dir: str) -> DataFrame:
    from lattica.operators.windows import merge_tail

    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    buckets = per_user.groupBy(F.least("n", F.lit(20)).cast("long").alias("bucket")).agg(F.count("*").alias("users"))
    return merge_tail(buckets, "bucket", "users", 5)


@query("a40_source_buckets", "SELECT source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2")
def source_buckets(spark: Spark, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return table(spark, sf_dir, "documents").groupBy("source", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("j12_dataset_merge", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS docs, coalesce(b.n, 0) AS labelled FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) b ON a.lang = b.lang")
def dataset_merge(spark: Spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = d.groupBy("lang").agg(F.count("*").alias("docs"))
    b = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("labelled"))
    return a.join(b, "lang", "full").select("lang", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), F.coalesce("labelled", F.lit(0)).cast("long").alias("labelled"))


@query("j15_set_compare", "WITH a AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS y FROM lineitem WHERE l_quantity > 10 GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(x, y)) / len(x), 6) AS recall, round(len(list_intersect(x, y)) / len(y), 6) AS precision FROM a JOIN b USING (l_orderkey)")
def set_compare(spark: Spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    both = line.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("x"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_partkey"))).alias("y")).where(F.size("y") > 0)
    same = F.size(F.array_intersect("x", "y"))
    return both.select("l_orderkey", F.round(same / F.size("x"), 6).alias("recall"), F.round(same / F.size("y"), 6).alias("precision"))


@query("u2_in_every_round", f"{_ROUNDS}, n AS (SELECT count(DISTINCT round) AS r FROM one) SELECT user_id FROM one, n GROUP BY user_id, r HAVING count(DISTINCT round) = r")
def in_every_round(spark: Spark, sf_dir: str) -> DataFrame:
    r = _rounds(spark, sf_dir)
    n = r.agg(F.count_distinct("round").alias("r"))
    return r.groupBy("user_id").agg(F.count_distinct("round").alias("c")).crossJoin(F.broadcast(n)).where("c = r").select("user_id")


@query("u3_set_difference", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def set_difference(spark: Spark, sf_dir: str) -> DataFrame:
    """Offsets that exist but aren't referred to by any large line."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").distinct().join(used, "p_partkey", "left_anti")


@query("t14_by_length", "SELECT conv_id, turn, row_number() OVER (ORDER BY length(coalesce(text, '')), conv_id, turn) AS place FROM conversations")
def by_length(spark: Spark, sf_dir: str) -> DataFrame:
    from lattica.operators.windows import numbered

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return numbered(t, ["n", "conv_id", "turn"], "place").select("conv_id", "turn", "place")


@query("q35_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 'train' ELSE 'test' END AS part FROM documents")
def split(spark: Spark, sf_dir: str) -> DataFrame:
    from lattica.operators.windows import numbered

    return numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "n").select("doc_id", F.when(F.col("n") <= 100, "train").otherwise("test").alias("part"))


@query("q33_chunk_packing", """WITH c AS (SELECT conv_id, turn, len(string_split(coalesce(text, ''), ' ')) AS n FROM conversations), a AS (SELECT conv_id, list(n ORDER BY turn) AS n, list(turn ORDER BY turn) AS t FROM c GROUP BY 1),
  f AS (SELECT conv_id, t, list_reduce(n, lambda acc, x: {'chunk': acc.chunk + CASE WHEN acc.total + x >= 96 THEN 1 ELSE 0 END, 'total': CASE WHEN acc.total + x >= 96 THEN 0 ELSE acc.total + x END, 'out': list_append(acc.out, acc.chunk)}, {'chunk': 0::BIGINT, 'total': 0::BIGINT, 'out': []::BIGINT[]}) AS r FROM a)
  SELECT conv_id, t[i] AS turn, CASE WHEN r.total > 0 AND r.chunk > 0 THEN least(r.out[i], r.chunk - 1) ELSE r.out[i] END AS chunk FROM f, unnest(range(1, len(t) + 1)) AS u(i)""")
def chunk_packing(spark: Spark, sf_dir: str) -> DataFrame:
    import pandas as pd

    from lattica.operators.selection import packed

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        return rows.assign(chunk=packed(rows["n"].tolist(), 32))[["conv_id", "turn", "chunk"]]

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"))
    return c.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, chunk long")
