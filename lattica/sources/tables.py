"""Triples, samples and graphs derived from the star-schema, text and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIPLES = ("dataset_id", "sample_id", "source_index", "triple_index", "triple_type", "subject", "predicate", "object", "title")


#: The tables that triples are made of.
TRIPLE_TABLES = ("nation", "region", "customer", "supplier", "orders", "lineitem", "part")


def snapshot(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TRIPLE_TABLES) -> tuple[str, ...]:
    """What the files of some tables are at the moment: path, length and time of change of each, as their file system lists them."""
    context = spark.sparkContext
    seen = []
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
        seen += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return tuple(sorted(seen))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triples(df: DataFrame, dataset: str, key: str, index: int | Column, kind: str, subject: Column, predicate: str, obj: Column) -> DataFrame:
    return df.select(
        F.lit(dataset).alias("dataset_id"),
        F.col(key).cast("string").alias("sample_id"),
        F.col(key).cast("long").alias("source_index"),
        (F.lit(index) if isinstance(index, int) else index.cast("int")).alias("triple_index"),
        F.lit(kind).alias("triple_type"),
        subject.alias("subject"),
        F.lit(predicate).alias("predicate"),
        obj.alias("object"),
        F.lit(dataset).alias("title"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw triples of the star schema, in the order (dataset_id, source_index, triple_index)."""
    t = lambda name: table(spark, sf_dir, name)
    nation, region = t("nation"), t("region")
    order = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    customers = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    part = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))
    # lines have no key of their own; their place in the order is one
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", place.alias("place"))
    line_order = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))
    supplied = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    parts = [
        _triples(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "nation", "n_nationkey", 0, "RELATION", F.col("n_name"), "part of", F.col("r_name")),
        _triples(customers, "customer", "c_custkey", 0, "RELATION", F.col("c_name"), "located in", F.col("n_name")),
        _triples(t("customer"), "customer", "c_custkey", 1, "ATTRIBUTE", F.col("c_name"), "market segment", F.col("c_mktsegment")),
        _triples(suppliers, "supplier", "s_suppkey", 0, "RELATION", F.col("s_name"), "located in", F.col("n_name")),
        _triples(orders, "orders", "o_orderkey", 0, "RELATION", order, "placed by", F.col("c_name")),
        _triples(t("orders"), "orders", "o_orderkey", 1, "ATTRIBUTE", order, "status", F.col("o_orderstatus")),
        _triples(t("orders"), "orders", "o_orderkey", 2, "ATTRIBUTE", order, "priority", F.col("o_orderpriority")),
        _triples(supplied, "lineitem", "l_orderkey", F.col("place") * 2, "RELATION", line_order, "supplied by", F.col("s_name")),
        _triples(lines, "lineitem", "l_orderkey", F.col("place") * 2 + 1, "RELATION", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), "sold in", line_order),
        _triples(t("part"), "part", "p_partkey", 0, "ATTRIBUTE", part, "brand", F.col("p_brand")),
        _triples(t("part"), "part", "p_partkey", 1, "ATTRIBUTE", part, "name", F.col("p_name")),
        _triples(t("part"), "part", "p_partkey", 2, "ATTRIBUTE", part, "type", F.col("p_type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bipartite multigraph of customers and parts: src, dst, score (quantity share), one row for each line."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), (F.col("l_quantity") / 50.0).alias("score"), "l_orderkey", "l_linenumber")


def sample_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_index and json: a question about each customer in the shapes that data sets have, by market segment.

    BUILDING has pairs of title and sentences, MACHINERY objects with triples,
    FURNITURE paragraphs, AUTOMOBILE one text and no id, HOUSEHOLD triples of its own.
    """
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = F.struct("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), "o_orderstatus", "o_orderpriority")
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(o)).alias("o"))
    c = customers.join(held, "c_custkey", "left").withColumn("o", F.coalesce("o", F.array().cast("array<struct<o_orderkey:bigint,title:string,o_orderstatus:string,o_orderpriority:string>>")))
    f = F.format_string
    each = lambda body: F.array_join(F.transform("o", body), ",")
    status, priority = (lambda x: x["o_orderstatus"]), (lambda x: x["o_orderpriority"])
    asked = F.concat(F.lit('"question":"Where is '), "c_name", F.lit('?","answer":"'), "n_name", F.lit('"'))
    key = F.col("c_custkey").cast("string")
    pairs = f('{"_id":"b%s",%s,"context":[%s],"supporting_facts":[%s]}', key, asked, each(lambda x: f('["%s",["Status %s."," Priority %s. ",""]]', x["title"], status(x), priority(x))), F.array_join(F.transform(F.filter("o", lambda x: status(x) == "F"), lambda x: f('["%s",0]', x["title"])), ","))
    triple = lambda x: f('{"type":"attribute","name":"%s","description_type":"status","description":"%s"}', x["title"], status(x))
    objects = f('{"id":%s,%s,"evidences":[%s],"context":[%s]}', key, asked, each(lambda x: f('"%s"', x["title"])), each(lambda x: f('{"title":"%s","sentences":["Status %s."],"triple_list":[%s]}', x["title"], status(x), triple(x))))
    paragraphs = f('{"id":"3hop1_%s",%s,"paragraphs":[%s]}', key, asked, each(lambda x: f('{"title":"%s","paragraph_text":"Status %s. Priority %s.","is_supporting":%s,"triples":[{"Head":"%s","Relation":"placed by","Tail":"%s"}]}', x["title"], status(x), priority(x), F.when(status(x) == "O", "true").otherwise("false"), x["title"], F.col("c_name"))))
    plain = f('{"Q":"Who is %s?","A":["%s","x"],"title":"%s","context":"Segment %s."}', F.col("c_name"), F.col("n_name"), F.col("c_name"), F.col("c_mktsegment"))
    own = f('{"id":%s,%s,"triple_list":[{"type":"RELATION","name":"%s","description_type":"located in","description":"%s"}],"context":[%s]}', key, asked, F.col("c_name"), F.col("n_name"), each(lambda x: f('{"title":"%s","sentences":[],"triple_list":[%s]}', x["title"], triple(x))))
    kind = F.col("c_mktsegment")
    json = F.when(kind == "BUILDING", pairs).when(kind == "MACHINERY", objects).when(kind == "FURNITURE", paragraphs).when(kind == "AUTOMOBILE", plain).otherwise(own)
    return c.select(F.col("c_custkey").alias("source_index"), json.alias("json"))


def question_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions about customers (sample, question, answer) and the pages they come with (sample, page, title, sentences).

    Two pages lead from a customer by its nation to its region; one of a MACHINERY
    customer speaks of it by pronouns, a HOUSEHOLD one lacks the nation's, and what an
    AUTOMOBILE one is asked stands in no page.
    """
    home = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    home = home.withColumn("sample", F.col("c_custkey").cast("string"))
    f, kind = F.format_string, F.col("c_mktsegment")
    founded = (1900 + F.length("c_name") + F.col("c_nationkey")).cast("string")
    question = F.when(kind == "AUTOMOBILE", f("When was %s founded?", "c_name")).otherwise(f("Which region is %s in?", "c_name"))
    questions = home.select("sample", question.alias("question"), F.when(kind == "AUTOMOBILE", founded).otherwise(F.col("r_name")).alias("answer"))
    own = F.when(kind == "MACHINERY", F.array(f("%s is a trader.", "c_name"), f("It is old and it was located in %s.", "n_name"))).otherwise(F.array(f("%s is located in %s.", "c_name", "n_name")))
    page = lambda n, title, sentences: F.struct(F.lit(n).alias("page"), F.col(title).alias("title"), sentences.alias("sentences"))
    first, second = page(0, "c_name", own), page(1, "n_name", F.array(f("%s lies in %s; its language is old.", "n_name", "r_name")))
    pages = F.when(kind == "HOUSEHOLD", F.array(first)).otherwise(F.array(first, second))
    return questions, home.select("sample", F.explode(pages).alias("p")).select("sample", "p.*")
