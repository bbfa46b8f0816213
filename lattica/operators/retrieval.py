"""From questions to candidate graphs: seeds, expansion under budgets, records of triples, and graphs for export.

Everything is keyed by (qid, seed) or qid, so budgets hold for each question and
work is spread over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import maybe_among, meeting
from lattica.operators.windows import numbered
from lattica.session import cut


def incident_triples(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """node_id and triple_id of the triples that begin or end at the given nodes (node_id); each pair once."""
    at = lambda side: triples.select(F.col(side).alias("node_id"), "triple_id").join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    return at("subject_id").union(at("object_id")).distinct()


def expand_budgeted(seeds: DataFrame, incident: DataFrame | Callable[[DataFrame], DataFrame], hops: int, max_triples: int, expandable: DataFrame | None = None) -> DataFrame:
    """qid, seed, triple_id and n (from 1): triples found breadth first from each seed (qid, seed), ``max_triples`` at most.

    Nodes are expanded in the order in which they were found, their triples by
    ``rank``; a seed that meets its budget stops before the last triple's far end.
    Nodes outside ``expandable`` are found but not expanded. Every level is cut to the
    budget before the next one begins.
    """
    key = ["qid", "seed"]
    seen = seeds.select(*key).distinct().select(*key, F.col("seed").alias("node_id"), F.lit(0).cast("long").alias("pos"))
    frontier, found = seen, None
    for hop in range(1, hops + 1):
        start = frontier.join(expandable.select("node_id"), "node_id", "left_semi") if expandable is not None else frontier
        # of a table of edges only what may meet the frontier is moved
        step = meeting(incident if callable(incident) else maybe_among(incident, start))(start)
        first = step.groupBy(*key, "triple_id").agg(F.min(F.struct("pos", "rank", "other_id")).alias("at"))
        had = F.lit(0)
        if found is not None:
            first = first.join(found.select(*key, "triple_id"), [*key, "triple_id"], "left_anti")
            first = first.join(found.groupBy(*key).agg(F.max("n").alias("had")), key, "left")
            had = F.coalesce("had", F.lit(0))
        order = Window.partitionBy(*key).orderBy("at.pos", "at.rank", "triple_id")
        new = cut(first.withColumn("n", (F.row_number().over(order) + had).cast("long")).where(F.col("n") <= max_triples).select(*key, "triple_id", "n", F.col("at.other_id").alias("other_id")))
        found = new.drop("other_id") if found is None else found.union(new.drop("other_id"))
        if hop < hops:
            reached = new.where(F.col("n") < max_triples).groupBy(*key, F.col("other_id").alias("node_id")).agg(F.min("n").alias("pos"))
            frontier = cut(reached.join(seen, [*key, "node_id"], "left_anti"))
            seen = seen.unionByName(frontier.select(*seen.columns))
    return found


def union_of_seeds(found: DataFrame) -> DataFrame:
    """qid, triple_id and seeds (how many found it): the subgraphs of a question's seeds as one."""
    return found.groupBy("qid", "triple_id").agg(F.count_distinct("seed").alias("seeds"))


def audit_expansion(seeds: DataFrame, triples: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """qid, hop, entities, triples and kvs: what lies within each number of hops, over relations between entities alone.

    A triple lies at one node or two. What a node's triples come to is summed once for
    the node, and what was counted at both its ends is taken off, so the triples of a
    neighbourhood are never listed. Records that several triples share are counted apart.
    """
    e = triples.where("triple_type = 'RELATION' and object_kind = 'entity'").select("triple_id", F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    moves = e.select(F.col("a").alias("node_id"), F.col("b").alias("other_id")).union(e.where("a != b").select("b", "a"))
    seen = seeds.select("qid", "node_id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.select("qid", "node_id").join(moves, "node_id").select("qid", F.col("other_id").alias("node_id")).distinct()
        frontier = cut(step.join(seen, ["qid", "node_id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    seen = cut(seen)

    linked = links.select("triple_id", "kv_offset").distinct()
    owners = linked.groupBy("kv_offset").agg(F.min("triple_id").alias("triple_id"), F.max("triple_id").alias("_last"))
    own = owners.where("triple_id = _last").groupBy("triple_id").agg(F.count("*").alias("_kvs"))
    ends = triples.select("triple_id", F.col("subject_id").alias("a"), F.when((F.col("triple_type") == "RELATION") & (F.col("object_kind") == "entity") & (F.col("subject_id") != F.col("object_id")), F.col("object_id")).alias("b"))
    weighed = cut(ends.join(own, "triple_id", "left").select("a", "b", F.coalesce("_kvs", F.lit(0)).alias("_kvs")))
    held = weighed.select(F.explode(F.array_compact(F.array("a", "b"))).alias("node_id"), "_kvs").groupBy("node_id").agg(F.count("*").alias("n"), F.sum("_kvs").alias("_kvs"))
    once = seen.join(held, "node_id").groupBy("qid", "hop").agg(F.sum("n").alias("n"), F.sum("_kvs").alias("kvs"))
    pairs = weighed.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("_kvs").alias("_kvs"))
    begun = seen.select("qid", F.col("node_id").alias("a"), F.col("hop").alias("_hop")).join(pairs, "a")
    twice = begun.join(seen.withColumnRenamed("node_id", "b"), ["qid", "b"]).groupBy("qid", F.greatest("hop", "_hop").alias("hop")).agg((-F.sum("n")).alias("n"), (-F.sum("_kvs")).alias("kvs"))

    shared = linked.join(owners.where("triple_id != _last").select("kv_offset"), "kv_offset", "left_semi").join(ends, "triple_id")
    at = shared.select("kv_offset", F.explode(F.array_compact(F.array("a", "b"))).alias("node_id")).distinct()
    apart = seen.join(at, "node_id").groupBy("qid", "kv_offset").agg(F.min("hop").alias("hop")).groupBy("qid", "hop").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("kvs"))

    new = once.union(twice).union(apart).select("qid", "hop", F.lit(0).cast("long").alias("entities"), "n", "kvs")
    new = new.union(seen.groupBy("qid", "hop").agg(F.count("*").alias("entities"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    within = new.select("qid", F.explode(F.sequence(F.col("hop"), F.lit(hops))).alias("hop"), "entities", "n", "kvs").groupBy("qid", "hop")
    return within.agg(F.sum("entities").alias("entities"), F.sum("n").alias("triples"), F.sum("kvs").alias("kvs"))


def records_of(triples: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """qid, triple_id, ordinal and the records of the triples (qid, triple_id) in order of their ordinals."""
    return triples.join(links, "triple_id").join(records.select("kv_offset", "key_text", "value_text"), "kv_offset").select("qid", "triple_id", "ordinal", "kv_offset", "key_text", "value_text")


def as_samples(questions: DataFrame, hydrated: DataFrame, records: DataFrame) -> DataFrame:
    """qid, question, context (always empty: no gold text may leak) and triple_list of candidate graphs.

    ``hydrated`` has qid and the triple's fields, ``records`` is the result of
    ``records_of``. A question without candidates has an empty list.
    """
    kv = records.groupBy("qid", "triple_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "key_text", "value_text", "kv_offset"))), lambda x: F.struct(x["key_text"].alias("key_string"), x["value_text"].alias("value_string"), x["kv_offset"].alias("kv_offset"))).alias("kv_lists"))
    fields = F.struct("triple_id", F.col("triple_type").alias("type"), F.col("subject_name").alias("name"), F.col("predicate").alias("description_type"), F.col("object_name").alias("description"), "title", "kv_lists")
    listed = hydrated.join(kv, ["qid", "triple_id"], "left").groupBy("qid").agg(F.array_sort(F.collect_list(fields)).alias("triple_list"))
    out = questions.select("qid", "question").join(listed, "qid", "left")
    empty = F.array().cast(listed.schema["triple_list"].dataType)
    return out.select("qid", "question", F.array().cast("array<string>").alias("context"), F.coalesce("triple_list", empty).alias("triple_list"))


def exported(edges: DataFrame) -> DataFrame:
    """qid, kv_nodes (edges in order of eid) and adj: [l, r] places of edges of which the second begins where the first ends."""
    placed = edges.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("eid")) - 1)
    fields = [c for c in edges.columns if c != "qid"]
    nodes = placed.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("kv_nodes"))
    left, right = placed.select("qid", F.col("place").alias("l"), F.col("dst").alias("at")), placed.select("qid", F.col("place").alias("r"), F.col("src").alias("at"))
    pairs = left.join(right, ["qid", "at"]).where("l != r").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("adj"))
    return nodes.join(pairs, "qid", "left").withColumn("adj", F.coalesce("adj", F.array().cast(pairs.schema["adj"].dataType)))


def top_per_question(scored: DataFrame, k: int, order: list[Column | str], by: str = "qid") -> DataFrame:
    """The ``k`` first rows of each question, with their rank; at least one."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= max(1, k))


def topic_entities(hits: DataFrame, k: int, mention_bonus: float = 0.35, lexical_weight: float = 0.15) -> DataFrame:
    """qid, node_id, topic_score, rank of hits (qid, node_id, score, mentioned, lexical): vector score, a bonus for a mention, and lexical overlap."""
    total = F.col("score") + F.when(F.col("mentioned"), mention_bonus).otherwise(0.0) + lexical_weight * F.col("lexical")
    return top_per_question(hits.withColumn("topic_score", total), k, [F.desc("topic_score"), "node_id"])


def in_first_order(scored: DataFrame, k: int, order: str) -> DataFrame:
    """The ``k`` best scored rows of each question, with place: where they stand in their first order."""
    best = top_per_question(scored, k, [F.desc("score"), order]).drop("rank")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(order)) - 1)


def two_hop_scores(first: DataFrame, second: DataFrame, alpha: float, beta: float, penalty: float = 0.0, similarity: str | None = None) -> DataFrame:
    """Paths of two hops (qid, mid) by alpha * first + beta * second, less ``penalty`` times the similarity of their ends where one is given."""
    joined = first.join(second, ["qid", "mid"])
    score = alpha * F.col("score1") + beta * F.col("score2") - (penalty * F.col(similarity) if similarity else F.lit(0.0))
    return joined.withColumn("score", score)


def with_fill(hits: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """qid, node_id, rank and filled: hits (qid, node_id, rank), then ``n`` others of the pool (distinct node_id) for each question, as good as random.

    The pool is numbered in order of a hash; a question takes the nodes that follow
    its own hash, as many as it needs beside its hits, so it never meets the whole
    pool. A pool of fewer others gives all of them.
    """
    ring = numbered(pool.select("node_id", F.xxhash64("node_id", F.lit(seed)).alias("h")), ["h", "node_id"], "at", 0).select("at", "node_id")
    size = F.broadcast(ring.agg(F.count("*").alias("size")))
    asked = hits.groupBy("qid").agg(F.max("rank").alias("had"), F.collect_set("node_id").alias("own")).crossJoin(size).where("size > 0")
    start = F.pmod(F.xxhash64("qid", F.lit(seed + 1)), F.col("size"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), (n + F.size("own")).cast("long")) - 1)
    near = asked.select("qid", "had", "own", F.posexplode(F.transform(steps, lambda i: F.pmod(start + i, F.col("size")))).alias("step", "at"))
    met = near.join(ring, "at").where(~F.array_contains("own", F.col("node_id")))
    fill = met.withColumn("_p", F.row_number().over(Window.partitionBy("qid").orderBy("step"))).where(F.col("_p") <= n)
    return hits.select("qid", "node_id", "rank", F.lit(False).alias("filled")).unionByName(fill.select("qid", "node_id", (F.col("had") + F.col("_p")).alias("rank"), F.lit(True).alias("filled")))


def compared(mine: DataFrame, other: DataFrame, item: str) -> DataFrame:
    """qid, n, n_other, same, exact, precision, recall and f1 of two sets of items of the questions that both have."""
    a = mine.groupBy("qid").agg(F.collect_set(item).alias("a"))
    b = other.groupBy("qid").agg(F.collect_set(item).alias("b"))
    both = a.join(b, "qid").select("qid", F.size("a").alias("n"), F.size("b").alias("n_other"), F.size(F.array_intersect("a", "b")).alias("same"))
    p, r = F.col("same") / F.greatest("n", F.lit(1)), F.col("same") / F.greatest("n_other", F.lit(1))
    return both.select("*", ((F.col("same") == F.col("n")) & (F.col("n") == F.col("n_other"))).alias("exact"), p.alias("precision"), r.alias("recall"), F.when(F.col("same") == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def segment_of(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (kv_offset) with the segment (segment_id, begin, end; end exclusive) they lie in; rows outside all have none.

    Segments don't overlap. Rows and segments meet in buckets as wide as the longest
    segment, so a row meets the few that its bucket holds.
    """
    width = F.broadcast(segments.agg(F.greatest(F.max(F.col("end") - F.col("begin")), F.lit(1)).alias("_w")))
    held = segments.crossJoin(width).withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / F.col("_w")), F.floor((F.col("end") - 1) / F.col("_w")))))
    rows = asked.crossJoin(width).withColumn("_b", F.floor(F.col("kv_offset") / F.col("_w"))).drop("_w")
    inside = (rows["_b"] == held["_b"]) & (rows["kv_offset"] >= held["begin"]) & (rows["kv_offset"] < held["end"])
    return rows.join(held.drop("_w"), inside, "left").select(*[rows[c] for c in asked.columns], "segment_id")


def shortlist_bonus(candidates: DataFrame, alias_table: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, node_id and bonus (2 + length / 64, 2.5 at most) of candidates one of whose aliases stands in the question (qid, words: `` a b ``)."""
    joined = candidates.select("qid", "node_id").join(alias_table.select("node_id", "alias_key"), "node_id").join(questions.select("qid", "words"), "qid")
    said = joined.where((F.length("alias_key") > 0) & F.contains("words", F.concat(F.lit(" "), "alias_key", F.lit(" "))))
    return said.groupBy("qid", "node_id").agg(F.max(2.0 + F.least(F.lit(0.5), F.length("alias_key") / 64.0)).alias("bonus"))


def exact_chains(t: DataFrame, by: str) -> DataFrame:
    """Pairs (i, j) of triples of one sample of which the second's subject is the first's object."""
    a = t.select(by, F.col("eid").alias("i"), F.col("object").alias("at"))
    b = t.select(by, F.col("eid").alias("j"), F.col("subject").alias("at"))
    return a.join(b, [by, "at"]).where("i != j").select(by, "i", "j")


def near_chains(t: DataFrame, by: str, least: int = 3, many: int = 1024) -> DataFrame:
    """Pairs (i, j) of triples of one sample of which one text holds the other: the second's subject and the first's object, both of ``least`` letters or more.

    Equal texts are compared once, and a pair of texts then unfolds into the pairs of its
    triples. Texts that more than ``many`` triples have are unfolded in parts, so the
    pairs of one sample don't stand in one task.
    """

    def held(text: str, name: str, eid: str) -> tuple[DataFrame, DataFrame]:
        rows = t.where(F.length(text) >= least).select(by, F.col("eid").alias(eid), F.lower(text).alias(name))
        texts = rows.groupBy(by, name).agg(F.ceil(F.count("*") / many).alias(f"n_{eid}"))
        dealt = rows.join(texts, [by, name]).withColumn(f"_{eid}", F.pmod(F.xxhash64(eid), f"n_{eid}"))
        return texts, dealt.groupBy(by, name, f"_{eid}").agg(F.collect_list(eid).alias(eid))

    (a, objects), (b, subjects) = held("object", "o", "i"), held("subject", "s", "j")
    parts = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    met = a.join(b, by).where(F.contains("o", F.col("s")) | F.contains("s", F.col("o")))
    met = met.select(by, "o", "s", "n_j", parts("n_i", "_i")).select(by, "o", "s", "_i", parts("n_j", "_j"))
    both = met.join(objects, [by, "o", "_i"]).select(by, "s", "_j", "i").join(subjects, [by, "s", "_j"])
    return both.select(by, "j", F.explode("i").alias("i")).select(by, "i", F.explode("j").alias("j")).where("i != j")


def near_chain_classes(t: DataFrame, by: str, least: int = 3) -> DataFrame:
    """The pairs of ``near_chains`` between classes of equal texts: by, part, i and j.

    A class has the triples of one sample with the same object (or subject) but for
    case, and is named by its least eid. Rows of part ``pair`` are the classes of objects
    (i) and of subjects (j) of which one text holds the other; ``object`` and ``subject``
    name each triple's (j) class (i). A pair stands for all its members' pairs but those
    of a triple with itself; one that would stand for none is left out.
    """

    def classes(text: str, rep: str, name: str) -> tuple[DataFrame, DataFrame]:
        rows = t.where(F.length(text) >= least).select(by, "eid", F.lower(text).alias(name))
        return rows, rows.groupBy(by, name).agg(F.min("eid").alias(rep), F.count("*").alias(f"n_{rep}"))

    (objects, a), (subjects, b) = classes("object", "i", "o"), classes("subject", "j", "s")
    itself = (F.col("i") == F.col("j")) & (F.col("n_i") == 1) & (F.col("n_j") == 1)
    pairs = a.join(b, by).where((F.contains("o", F.col("s")) | F.contains("s", F.col("o"))) & ~itself).select(by, F.lit("pair").alias("part"), "i", "j")
    members = lambda rows, c, rep, name, part: rows.join(c.select(by, name, F.col(rep).alias("_rep")), [by, name]).select(by, F.lit(part).alias("part"), F.col("_rep").alias("i"), F.col("eid").alias("j"))
    return pairs.union(members(objects, a, "i", "o", "object")).union(members(subjects, b, "j", "s", "subject"))


def ancestors(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, sink, node: everything that leads to each sink (qid, node), the sink itself included; a round for each step of the longest way."""
    seen = cut(ends.select("qid", F.col("node").alias("sink"), "node").distinct())
    frontier, back = seen, edges.select("qid", F.col("dst").alias("node"), F.col("src").alias("before")).distinct()
    while not frontier.isEmpty():
        step = frontier.join(back, ["qid", "node"]).select("qid", "sink", F.col("before").alias("node")).distinct()
        frontier = cut(step.join(seen, ["qid", "sink", "node"], "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def appended(existing: DataFrame, new: DataFrame, key: str, number: str, order: list[str]) -> DataFrame:
    """Existing rows and those of ``new`` (unique by key) whose key they lack, numbered on from the highest number."""
    fresh = numbered(new.join(existing.select(key), key, "left_anti"), order, "_new")
    last = existing.agg(F.coalesce(F.max(number), F.lit(-1)).alias("_last"))
    return existing.unionByName(fresh.crossJoin(F.broadcast(last)).withColumn(number, (F.col("_last") + F.col("_new")).cast("long")).select(*existing.columns))
