"""Iterated graph operators: each step is a join and a partially aggregated group.

Edges are tables with src and dst. Loops run over hops, never over rows; long
ones cut their lineage into the checkpoint folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.windows import exclusive_offsets
from lattica.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, n_total over a multigraph; a loop counts on both sides."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("n_total"))


def node_features(edges: DataFrame, columns: list[str]) -> DataFrame:
    """node, n_in, n_out and for each column mean and maximum over in- and out-edges; a side without edges has zeros."""
    parts = []
    for side, end in (("in", "dst"), ("out", "src")):
        values = [f(c).alias(f"{name}_{side}_{c}") for c in columns for name, f in (("mean", F.avg), ("max", F.max))]
        parts.append(edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias(f"n_{side}"), *values))
    return parts[0].join(parts[1], "node", "full").fillna(0)


def meeting(incident: DataFrame | Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """How a frontier (with node_id) meets its triples: a join with a table of them, or what a function of the frontier gives."""
    return incident if callable(incident) else lambda frontier: frontier.join(incident.select("node_id", "triple_id", "other_id", *(["rank"] if "rank" in incident.columns else [])), "node_id")


def maybe_among(df: DataFrame, ids: DataFrame, column: str = "node_id") -> DataFrame:
    """The rows whose number may be among ``ids``: all that are, and the few others that share a bit of a filter of at most 8 million bits with one."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << 23))
    # words of 64 bits, 512 of them in a row, so that a look at a bit is a look into an array
    one = F.expr("shiftleft(1L, cast(_at & 63 AS int))")
    words = ids.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    held = words.groupBy(F.shiftright("_word", 9).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_word").bitwiseAND(511), "_bits"))).alias("_of"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(511).cast("long")), lambda i: F.coalesce(F.try_element_at("_of", i), F.lit(0).cast("long")))
    met = df.withColumn("_at", place).withColumn("_row", F.shiftright("_at", 15)).join(F.broadcast(held.select("_row", filled.alias("_words"))), "_row")
    bit = F.bit_get(F.get("_words", F.shiftright("_at", 6).bitwiseAND(511).cast("int")), F.col("_at").bitwiseAND(63).cast("int"))
    return met.where(bit == 1).select(*df.columns)


def k_hop(seeds: DataFrame, incident: DataFrame | Callable[[DataFrame], DataFrame], hops: int, expandable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion from seeds (qid, node_id): (nodes with depth, triples by qid).

    ``incident`` has node_id, triple_id and other_id, capped as wanted. Nodes
    outside ``expandable`` (node_id) are reached but not expanded. No hops gives
    the seeds and no triples.
    """
    seen = seeds.select("qid", "node_id").distinct().withColumn("depth", F.lit(0))
    frontier, found = seen, None
    for hop in range(1, hops + 1):
        start = frontier.join(expandable, "node_id", "left_semi") if expandable is not None else frontier
        step = meeting(incident)(start.select("qid", "node_id"))
        triples = step.select("qid", "triple_id")
        found = triples if found is None else found.union(triples)
        new = step.select("qid", F.col("other_id").alias("node_id")).distinct().join(seen.select("qid", "node_id"), ["qid", "node_id"], "left_anti")
        frontier = new.withColumn("depth", F.lit(hop))
        if hop < hops:
            frontier = cut(frontier)
        seen = seen.union(frontier)
    empty = seen.select("qid", F.col("node_id").alias("triple_id")).where("false")
    return seen, (found.distinct() if found is not None else empty)


def hop_distances(sources: DataFrame, edges: DataFrame, max_hops: int, directed: bool = False) -> DataFrame:
    """qid, node and the fewest hops (at most ``max_hops``) from any of the query's sources (qid, node).

    Edges (src, dst) are those of all queries, or with a qid those of each one.
    """
    own = ["qid"] if "qid" in edges.columns else []
    moves = edges.select(*own, "src", "dst")
    if not directed:
        moves = moves.union(edges.select(*own, "dst", "src"))
    moves = moves.distinct().withColumnsRenamed({"src": "node", "dst": "_to"})
    seen = sources.select("qid", "node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.select("qid", "node").join(moves, [*own, "node"]).select("qid", F.col("_to").alias("node")).distinct()
        frontier = step.join(seen, ["qid", "node"], "left_anti").withColumn("hops", F.lit(hop))
        if hop < max_hops:
            frontier = cut(frontier)
        seen = seen.union(frontier)
    return seen


def shortest_path_support(sources: DataFrame, targets: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """Edges on some shortest path from a source to a target: d(s, u) + 1 + d(v, t) = d(s, t), directed; with qid.

    Edges (src, dst) are those of all queries, or with a qid those of each one.
    """
    own = ["qid"] if "qid" in edges.columns else []
    ahead = hop_distances(sources, edges, max_hops, directed=True)
    back = hop_distances(targets, edges.select(*own, F.col("dst").alias("src"), F.col("src").alias("dst")), max_hops, directed=True)
    best = ahead.join(targets.select("qid", "node"), ["qid", "node"]).groupBy("qid").agg(F.min("hops").alias("best"))
    u = ahead.select("qid", F.col("node").alias("src"), F.col("hops").alias("du"))
    v = back.select("qid", F.col("node").alias("dst"), F.col("hops").alias("dv"))
    joined = edges.select(*own, "src", "dst").distinct().join(u, [*own, "src"]).join(v, ["qid", "dst"]).join(best, "qid")
    return joined.where("du + 1 + dv = best").select("qid", "src", "dst")


def reachable(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, node: everything that directed edges (qid, src, dst) lead to, the sources included; a round for each step of the longest way."""
    seen = cut(sources.select("qid", "node").distinct())
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(edges.select("qid", "src", "dst"), (frontier["qid"] == edges["qid"]) & (F.col("node") == F.col("src"))).select(frontier["qid"], F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["qid", "node"], "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def diffusion(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """node, step, forward, backward: seed mass moved ``hops`` times along edges, shared by in-degree, and against them, by out-degree.

    Parallel edges count each. Step 0 is the seed mass.
    """
    out = seeds.select("node", F.lit(0).alias("step"), F.col("mass").alias("forward"), F.col("mass").alias("backward"))
    moved = {}
    for way, src, dst in (("forward", "src", "dst"), ("backward", "dst", "src")):
        at = seeds.select("node", "mass")
        count = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("n"))
        for step in range(1, hops + 1):
            sums = edges.join(at, F.col(src) == F.col("node")).groupBy(F.col(dst).alias("to")).agg(F.sum("mass").alias("mass"))
            at = sums.join(count, F.col("to") == F.col("node")).select("node", (F.col("mass") / F.col("n")).alias("mass"))
            if step < hops:
                at = cut(at)
            moved[way, step] = at.select("node", F.lit(step).alias("step"), F.col("mass").alias(way))
    for step in range(1, hops + 1):
        both = moved["forward", step].join(moved["backward", step].drop("step"), "node", "full")
        out = out.union(both.select("node", F.lit(step), F.coalesce("forward", F.lit(0.0)), F.coalesce("backward", F.lit(0.0))))
    return out


def transition(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Counts of neighbours both ways, each row divided by its sum: src, dst, weight. A loop counts twice.

    Of ``nodes`` (node) those without an edge move to themselves.
    """
    sym = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select("x.*")
    counts = sym.groupBy("src", "dst").agg(F.count("*").alias("c"))
    total = counts.groupBy("src").agg(F.sum("c").alias("t"))
    moves = counts.join(total, "src").select("src", "dst", (F.col("c") / F.col("t")).alias("weight"))
    if nodes is None:
        return moves
    alone = nodes.select(F.col("node").alias("src")).distinct().join(total, "src", "left_anti")
    return moves.union(alone.select("src", F.col("src").alias("dst"), F.lit(1.0)))


def bipartite(edges: DataFrame) -> DataFrame:
    """Edges (eid, src, dst) as a graph of nodes and edges: each edge a node of its own (-1 - eid) beside both its ends."""
    own = (-1 - F.col("eid")).alias("dst")
    return edges.select(F.col("src"), own).union(edges.select(F.col("dst").alias("src"), own))


def personalised_pagerank(moves: DataFrame, start: DataFrame, alpha: float = 0.15, iterations: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """node, rank: steps r = (1 - alpha) * T'r + alpha * start until they change by less than ``tolerance`` in sum, ``iterations``
    at most; ranks sum to one at the end. A tolerance of 0 takes all steps.

    ``moves`` is a row-normalised transition (src, dst, weight); ``start`` has node and p. Each step is one
    join and one partially aggregated sum; the lineage is cut at each step that is measured, else at every third.
    """
    moves, start = cut(moves), cut(start)
    rank = start.select("node", F.col("p").alias("rank"))
    for k in range(iterations):
        walked = moves.join(rank, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("weight") * F.col("rank") * (1 - alpha)).alias("part"))
        jumped = start.select("node", (F.col("p") * alpha).alias("part"))
        former, rank = rank, walked.union(jumped).groupBy("node").agg(F.sum("part").alias("rank"))
        if tolerance > 0:
            rank = cut(rank)
            apart = rank.join(former.withColumnRenamed("rank", "was"), "node", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
            if (apart or 0.0) < tolerance:
                break
        elif k % 3 == 2:
            rank = cut(rank)
    total = rank.agg(F.sum("rank").alias("total"))
    return rank.crossJoin(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))


def rank_edges(edges: DataFrame, ranks: DataFrame, memory: DataFrame, query_weight: float, leaf_bonus: float) -> DataFrame:
    """Add score: the ranks of both ends, the edge's own rank in the bipartite graph (``memory``: node, rank), its lexical
    share (``lexical``) by ``query_weight``, and a bonus for attributes (``is_attribute``)."""
    end = lambda side: ranks.select(F.col("node").alias(side), F.col("rank").alias(f"_{side}"))
    own = memory.where("node < 0").select((-1 - F.col("node")).alias("eid"), F.col("rank").alias("_own"))
    joined = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left").join(own, "eid", "left").fillna(0.0, ["_src", "_dst", "_own"])
    score = F.col("_src") + F.col("_dst") + F.col("_own") + query_weight * F.col("lexical") + F.when(F.col("is_attribute"), leaf_bonus).otherwise(0.0)
    return joined.withColumn("score", score).drop("_src", "_dst", "_own")


def line_graph(edges: DataFrame) -> DataFrame:
    """qid, i, j: edge j (qid, eid, src, dst) begins where edge i ends."""
    a = edges.select("qid", F.col("eid").alias("i"), F.col("dst").alias("at"))
    b = edges.select("qid", F.col("eid").alias("j"), F.col("src").alias("at"))
    return a.join(b, ["qid", "at"]).where("i != j").select("qid", "i", "j")


def multi_hop_adjacency(adj: DataFrame, hops: int, decay: float) -> DataFrame:
    """i, j, weight: adjacency plus decay**(h - 1) for each longer exact hop count h at which j can be reached."""
    pairs = adj.select("i", "j").distinct()
    step, terms = pairs, pairs.select("i", "j", F.lit(1.0).alias("w"))
    for h in range(2, hops + 1):
        step = step.join(pairs.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", F.col("k").alias("j")).distinct()
        if h < hops:
            step = cut(step)
        terms = terms.union(step.select("i", "j", F.lit(decay ** (h - 1)).alias("w")))
    return terms.groupBy("i", "j").agg(F.sum("w").alias("weight"))


def topological_layers(edges: DataFrame) -> DataFrame:
    """qid, node, layer: the longest distance from a node without in-edges; nodes on or behind a cycle are left out. A round for each layer."""
    e = edges.select("qid", "src", "dst").distinct()
    left = cut(e.select("qid", F.col("src").alias("node")).union(e.select("qid", F.col("dst").alias("node"))).distinct())
    done = None
    for layer in itertools.count():
        blocked = e.join(left.select("qid", F.col("node").alias("src")), ["qid", "src"]).select("qid", F.col("dst").alias("node")).distinct()
        free = cut(left.join(blocked, ["qid", "node"], "left_anti").withColumn("layer", F.lit(layer)))
        done = free if done is None else done.union(free)
        if free.isEmpty():
            return done
        left = cut(left.join(free, ["qid", "node"], "left_anti"))


def sinks(edges: DataFrame) -> DataFrame:
    """qid, node: ends of edges without out-edges."""
    return edges.select("qid", F.col("dst").alias("node")).distinct().join(edges.select("qid", F.col("src").alias("node")).distinct(), ["qid", "node"], "left_anti")


def per_source_cap(edges: DataFrame, cap: int, by: list[str], score: str = "score", tie: str = "eid") -> DataFrame:
    """The ``cap`` best edges of each group."""
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("_r") <= cap).drop("_r")


def best_edge(edges: DataFrame, tie: str = "eid") -> DataFrame:
    """The best scored edge of each (qid, src, dst, relation); equal scores go to the lowest ``tie``."""
    rest = [c for c in edges.columns if c not in ("qid", "src", "dst", "relation")]
    best = edges.groupBy("qid", "src", "dst", "relation").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col(tie))).alias("b"))
    return best.select("qid", "src", "dst", "relation", "b.*")


def edge_cost(score: Column, attribute: Column) -> Column:
    return F.greatest(F.lit(0.02), 1.25 - score + 0.1 * attribute.cast("double"))


def joint_score(edges: DataFrame, ends: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
    """Add score = s + alpha * end(dst) - beta * end(src) - gamma * end(src) * best in-edge of src; ``edges`` has edge_score, ``ends`` node and end_score."""
    best = edges.groupBy(F.col("dst").alias("src")).agg(F.greatest(F.max("edge_score"), F.lit(0.0)).alias("best_in"))
    end = lambda side: ends.select(F.col("node").alias(side), F.col("end_score").alias(f"end_{side}"))
    joined = edges.join(best, "src", "left").join(end("src"), "src", "left").join(end("dst"), "dst", "left").fillna(0.0, ["best_in", "end_src", "end_dst"])
    score = F.col("edge_score") + alpha * F.col("end_dst") - beta * F.col("end_src") - gamma * F.col("end_src") * F.col("best_in")
    return joined.withColumn("score", score).drop("best_in", "end_src", "end_dst")


def rank_prizes(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """prize: k for the best row of a group, k - 1 for the next, down to 0."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "eid"))
    return scored.withColumn("prize", F.greatest(k + 1 - rank, F.lit(0)))


def direction_pairs(edges: DataFrame, keep_when_tie: bool = True) -> DataFrame:
    """One direction of each unordered pair of an ATTRIBUTE edge: the better scored one; a tie keeps both, or else the lower eid."""
    pair = Window.partitionBy("qid", F.least("src", "dst"), F.greatest("src", "dst"))
    if keep_when_tie:
        return edges.withColumn("_m", F.max("score").over(pair)).where("triple_type != 'ATTRIBUTE' or score = _m").drop("_m")
    return edges.withColumn("_r", F.row_number().over(pair.orderBy(F.desc("score"), "eid"))).where("triple_type != 'ATTRIBUTE' or _r = 1").drop("_r")


def block_diagonal(adj: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries (qid, i, j, w) of many graphs in one matrix: offsets are the running sums of ``sizes`` (qid, n) in order of qid."""
    at = exclusive_offsets(sizes.select("qid", "n"), "qid", "n", "offset").select("qid", "offset")
    return adj.join(at, "qid").select((F.col("i") + F.col("offset")).alias("i"), (F.col("j") + F.col("offset")).alias("j"), "w")


def path_attention(attention: DataFrame, adj: DataFrame, mix: float, floor: float = 1e-9) -> DataFrame:
    """row, kv, weight: attention mixed with what flows along the adjacency, each row scaled back to its former mass."""
    flowed = attention.join(adj.select(F.col("i").alias("kv"), "j", "w"), "kv").select("row", F.col("j").alias("kv"), (F.col("weight") * F.col("w") * mix).alias("part"))
    own = attention.select("row", "kv", (F.col("weight") * (1 - mix)).alias("part"))
    summed = flowed.union(own).groupBy("row", "kv").agg(F.sum("part").alias("part"))
    mass = attention.groupBy("row").agg(F.sum("weight").alias("mass"))
    total = Window.partitionBy("row")
    return summed.join(mass, "row").select("row", "kv", (F.col("part") / F.greatest(F.sum("part").over(total), F.lit(floor)) * F.col("mass")).alias("weight"))
