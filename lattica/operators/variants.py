"""Steps of extractor variants: scalars, scores and prizes of edges and nodes, edits, fills, and tree and beam searches.

Tables are keyed by question; searches that depend on order run on one question's
edges at a time (see ``selection``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.selection import Board, Budget, Edge, budgeted_select, build_dag, orient, pair_costs, steiner_tree, within_reach, without_cycles
from lattica.operators.windows import numbered

#: How relation phrases are brought to one name, the first that applies; phrases too weak to keep.
RELATION_SYNONYMS = (("directed", "director"), ("son of", "parent"), ("daughter of", "parent"), ("won", "award received"), ("economy", "economy class"), ("promo", "promotion"))
WEAK_RELATIONS = ("is", "was", "has", "have", "had", "be")


def _at(seed: Column, n: Column | int) -> Column:
    """A number below n that the seed's hash gives."""
    return F.pmod(F.conv(F.substring(F.md5(seed.cast("string")), 1, 8), 16, 10).cast("long"), n)


def exact_mean(c: str) -> Column:
    """The mean of a column summed in decimals of ten places, so that the order of its rows doesn't matter."""
    return F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count(c)


def edge_scalars(edges: DataFrame) -> DataFrame:
    """Add of_best (score by the source's best), over_mean (score less the target's mean), out_share and log_in."""
    into = edges.groupBy("dst").agg(F.count("*").alias("_in"), exact_mean("score").alias("_mean"))
    out = edges.groupBy("src").agg(F.count("*").alias("_out"), F.max("score").alias("_best"))
    e = edges.join(into, "dst").join(out, "src")
    added = {"of_best": F.col("score") / F.col("_best"), "over_mean": F.col("score") - F.col("_mean"), "out_share": 1 / F.col("_out"), "log_in": F.log1p("_in")}
    return e.withColumns(added).drop("_in", "_mean", "_out", "_best")


def linear(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.col(name)
    return total


def made_network(inputs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights of a network of one hidden layer, drawn by a seed; a trained one has the same names."""
    rng = np.random.default_rng(seed)
    return {"w1": rng.normal(0, 0.5, (inputs, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.5, hidden), "b2": np.zeros(1)}


def network_scores(scalars: DataFrame, columns: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """Add chance: the logistic output of the network over the named columns, a null counting as 0; weights go out once."""
    shared = scalars.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x = np.stack([np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in columns], 1)
            z = np.maximum(x @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names, "chance"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in scalars.dtypes)
    return scalars.mapInArrow(run, f"{kinds}, chance double")


def prize_problem(edges: DataFrame, cost: float) -> DataFrame:
    """qid, eid, src, dst, cost and prize of edges with a prize: one up to ``cost`` costs the rest; one above becomes a
    node of its own (-1 - eid) that is worth the rest, with free edges from and to the ends. Loops are left as they are given."""
    plain = edges.where(F.col("prize") <= cost).select("qid", "eid", "src", "dst", F.round(cost - F.col("prize"), 6).alias("cost"), F.lit(0.0).alias("prize"))
    own, worth = (-1 - F.col("eid")), (F.col("prize") - cost)
    ends = F.explode(F.array(F.struct("src", own.alias("dst")), F.struct(own.alias("src"), F.col("dst")))).alias("x")
    virtual = edges.where(F.col("prize") > cost).select("qid", "eid", ends, worth.alias("prize")).select("qid", "eid", "x.src", "x.dst", F.lit(0.0).alias("cost"), "prize")
    return plain.unionByName(virtual)


def node_prizes(edges: DataFrame, similarity: Column, mentioned: Column, value_like: Column) -> DataFrame:
    """qid, node and prize: similarity, 1.2 for a mention, half the best edge, 0.15 by degree, less 0.15 for a value."""
    ends = edges.select("qid", F.explode(F.array("src", "dst")).alias("node"), "score").groupBy("qid", "node").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    degree = F.least(F.lit(1.0), F.log1p("n") / F.log(F.lit(6.0)))
    return ends.select("qid", "node", (similarity + F.when(mentioned, 1.2).otherwise(0.0) + 0.5 * F.col("best") + 0.15 * degree - F.when(value_like, 0.15).otherwise(0.0)).alias("prize"))


def path_chains(steps: DataFrame, path: str, order: list[str]) -> DataFrame:
    """path, i, j: places of steps that follow one another."""
    place = F.row_number().over(Window.partitionBy(path).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(path))
    return steps.select(path, place.alias("j"), n.alias("n")).where(F.col("j") < F.col("n")).select(path, (F.col("j") - 1).alias("i"), "j")


def cumulative(rounds: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Per key and round: n_nodes up to and with it, last (its own number) and before (nodes of former rounds; null in the first)."""
    w = Window.partitionBy(key).orderBy(order)
    return rounds.select(key, order, F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n_nodes"), F.col(order).alias("last"), F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


def silver_first(paths: DataFrame, key: str, exact: Column, holds: Column) -> DataFrame:
    """Add swapped: the first path that matches exactly, else the first that holds the answer, and the first path change places."""
    best = paths.where(holds | exact).groupBy(key).agg(F.min_by("place", F.struct(F.when(exact, 0).otherwise(1), F.col("place"))).alias("_silver"))
    place = F.col("place")
    swapped = F.when(F.col("_silver").isNull(), place).when(place == 0, F.col("_silver")).when(place == F.col("_silver"), 0).otherwise(place)
    return paths.join(best, key, "left").withColumn("swapped", swapped).drop("_silver")


def inserted(rows: DataFrame, key: str, value: str, new: int) -> DataFrame:
    """Rows (key, value, place) with one more value for each key at a place the key's hash gives; those from there on move on by one."""
    at = rows.groupBy(key).agg(F.count("*").alias("_n")).select(key, _at(F.col(key), F.col("_n") + 1).alias("_at"))
    moved = rows.join(at, key).select(key, value, (F.col("place") + (F.col("place") >= F.col("_at")).cast("long")).alias("place"))
    return moved.union(at.select(key, F.lit(new).cast("long"), "_at"))


def mapped_relations(df: DataFrame, most_words: int = 6) -> DataFrame:
    """Rows with their relation under one name; those of weak or too long relations are left out."""
    named = F.coalesce(*[F.when(F.contains("relation", F.lit(a)), F.lit(b)) for a, b in RELATION_SYNONYMS], F.col("relation"))
    return df.withColumn("relation", named).where((F.size(F.split("relation", " ")) <= most_words) & ~F.col("relation").isin(*WEAK_RELATIONS))


EDIT_TYPES = ("attribute_update", "attribute_insert", "relation_update", "relation_insert")


def edit_rounds(samples: DataFrame, key: str, rounds: int, n: int) -> DataFrame:
    """In each round the ``n`` samples of least hash, each with an edit type; ranks are taken in distributed order."""
    seeded = samples.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    hashed = seeded.withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("round").cast("string"))), 1, 8), 16, 10).cast("long"))
    picked = None
    for k in range(1, rounds + 1):
        part = hashed.where(F.col("round") == k).orderBy("_h", key).limit(n)
        picked = part if picked is None else picked.union(part)
    kind = F.element_at(F.array(*[F.lit(t) for t in EDIT_TYPES]), (F.pmod("_h", F.lit(len(EDIT_TYPES))) + 1).cast("int"))
    return picked.withColumn("edit_type", kind).drop("_h")


def training_edges(edges: DataFrame, negatives: int) -> DataFrame:
    """Labelled edges, and of each question's others the ``negatives`` best, with ``hard``: those that leave the end of a labelled one come first."""
    ends = edges.where("label").select("qid", F.col("dst").alias("src"), F.lit(True).alias("hard")).distinct()
    marked = edges.join(ends, ["qid", "src"], "left").withColumn("hard", F.coalesce("hard", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("qid", "label").orderBy(F.desc(F.col("score") + F.when(F.col("hard"), 5.0).otherwise(0.0)), "eid"))
    return marked.withColumn("_r", rank).where(F.col("label") | (F.col("_r") <= negatives)).drop("_r")


def append_vectors(have: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Vectors (kv_offset, embedding) with new ones behind the last offset; a vector of another length stops the job."""
    last = have.agg(F.coalesce(F.max("kv_offset"), F.lit(-1)).alias("_last"), F.max(F.size("embedding")).alias("_size"))
    fresh = numbered(new, [order], "_new").crossJoin(F.broadcast(last))
    wrong = F.col("_size").isNotNull() & (F.size("embedding") != F.col("_size"))
    checked = F.when(wrong, F.raise_error(F.lit("a vector of another length"))).otherwise(F.col("embedding"))
    return have.select("kv_offset", "embedding").union(fresh.select((F.col("_last") + F.col("_new")).cast("long"), checked))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """qid, edges, nodes, sinks, relevance (mean score) and density of each question's graph."""
    nodes = edges.select("qid", F.explode(F.array("src", "dst")).alias("node")).distinct()
    leaving = edges.select("qid", F.col("src").alias("node"), F.lit(1).alias("_out")).distinct()
    per = nodes.join(leaving, ["qid", "node"], "left").groupBy("qid").agg(F.count("*").alias("nodes"), F.count_if(F.col("_out").isNull()).alias("sinks"))
    e = edges.groupBy("qid").agg(F.count("*").alias("edges"), exact_mean("score").alias("relevance"))
    return e.join(per, "qid").withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) + 1))


def relation_paths(edges: DataFrame, max_hops: int) -> DataFrame:
    """qid, hops and path (eids): the first shortest way from a question's least node to its greatest, in any direction.

    Ways grow by a step a round for all questions at once; a node keeps the way that
    comes first in order of its eids.
    """
    ends = edges.groupBy("qid").agg(F.min(F.least("src", "dst")).alias("a"), F.max(F.greatest("src", "dst")).alias("z"))
    moves = edges.select("qid", F.col("src").alias("node"), F.col("dst").alias("to"), "eid").union(edges.select("qid", "dst", "src", "eid"))
    seen = ends.select("qid", F.col("a").alias("node"), F.array().cast("array<bigint>").alias("path"))
    frontier = seen
    for _ in range(max_hops):
        step = frontier.join(moves, ["qid", "node"]).select("qid", F.col("to").alias("node"), F.concat("path", F.array("eid")).alias("path"))
        frontier = step.groupBy("qid", "node").agg(F.min("path").alias("path")).join(seen.select("qid", "node"), ["qid", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen.join(ends.select("qid", F.col("z").alias("node")), ["qid", "node"]).select("qid", F.size("path").alias("hops"), "path")


def connected_first(edges: list[Edge], topics: list[int], max_edges: int, max_nodes: int = 24) -> set[int]:
    """Best first, edges that touch what is there; then, if there is room, any others."""
    board = Board(edges, topics)

    def open_() -> bool:
        return int(board.on.sum()) < max_edges and int(board.used.sum()) < max_nodes

    for need in (True, False):
        for row in np.flatnonzero(~board.on).tolist():
            if not open_():
                break
            if not need or board.used[board.src[row]] or board.used[board.dst[row]]:
                board.on[row] = board.used[board.src[row]] = board.used[board.dst[row]] = True
    return board.ids(board.on)


def two_way_beam(edges: list[Edge], seeds: int, width: int, hops: int, max_edges: int) -> set[int]:
    """From the best edges beams go both ways by sums of scores, ``width`` wide, as long as no cycle closes."""
    board = Board(edges, [])
    board.on[: min(seeds, len(board.eid))] = True
    acyclic = without_cycles([e for e in edges if e.eid in board.ids(board.on)])
    board.on = np.isin(board.eid, np.array(sorted(acyclic), np.int64))
    for into, out_of in ((board.src, board.dst), (board.dst, board.src)):
        # a beam of (row, sum): the next row's out_of end is the former one's into end
        beam = [(int(r), float(board.score[r])) for r in np.flatnonzero(board.on)]
        for _ in range(hops):
            options: dict[int, float] = {}
            for row, total in beam:
                for k in np.flatnonzero(~board.on & (out_of == into[row])).tolist():
                    options[k] = max(options.get(k, -np.inf), total + float(board.score[k]))
            beam = []
            for k, total in sorted(options.items(), key=lambda x: (-x[1], x[0]))[:width]:
                closes = board.closes(k)
                if not closes and board.on.sum() < max_edges:
                    board.on[k] = True
                    beam.append((k, total))
    return board.ids(board.on)


def _costs(edges: list[Edge]) -> list[tuple[int, int, float]]:
    return [(e.src, e.dst, max(0.02, 1.25 - e.score)) for e in edges if e.src != e.dst]


def _edges_of(edges: list[Edge], pairs: Iterable[tuple[int, int]]) -> set[int]:
    """For each pair of nodes the best edge between them."""
    best: dict[frozenset[int], Edge] = {}
    for e in edges:
        pair = frozenset((e.src, e.dst))
        if pair not in best or (-e.score, e.eid) < (-best[pair].score, best[pair].eid):
            best[pair] = e
    return {best[frozenset(p)].eid for p in pairs}


def steiner_edges(edges: list[Edge], topics: list[int], best: int) -> set[int]:
    """Edges of a cheap tree over the topics and the ends of the ``best`` best edges, in the order in which they lead away from the first topic."""
    top = sorted(edges, key=lambda e: (-e.score, e.eid))[:best]
    terminals = [*topics, *[n for e in top for n in (e.src, e.dst)]]
    tree = steiner_tree(_costs(edges), terminals)
    return _edges_of(edges, orient(tree, min(terminals)) or tree) if tree else set()


def group_steiner(edges: list[Edge], groups: list[set[int]], most_roots: int = 12) -> set[int]:
    """Edges of the cheapest of the trees that join each of some roots with the nearest node of every group.

    Roots are the nodes of the smallest group that the graph has, and then others by degree.
    """
    nodes = {n for e in edges for n in (e.src, e.dst)}
    held = [g & nodes for g in groups if g & nodes]
    if not held or not nodes:
        return set()
    degree: dict[int, int] = defaultdict(int)
    for e in edges:
        degree[e.src] += 1
        degree[e.dst] += 1
    first = sorted(min(held, key=lambda g: (len(g), sorted(g))))
    roots = [*first, *sorted(nodes - set(first), key=lambda n: (-degree[n], n))][:most_roots]
    cheapest = pair_costs(_costs(edges))
    nearest = [min(g, key=lambda n: (-degree[n], n)) for g in held]
    trees, made, known = [], {}, {}
    for root in roots:
        goals = frozenset([root, *[root if root in g else n for g, n in zip(held, nearest, strict=True)]])
        if goals not in made:
            made[goals] = steiner_tree(cheapest, list(goals), known=known)
        tree = made[goals]
        covered = {n for p in tree for n in p} | {root}
        if all(g & covered for g in held):
            trees.append((round(sum(cheapest[p] for p in tree), 9), sorted(map(sorted, tree)), tree))
    return _edges_of(edges, min(trees)[2]) if trees else set()


def answers_at_ends(edges: list[Edge], topics: list[int], answers: set[int]) -> set[int]:
    """The best of the answer nodes that have in-edges (none of the topics, if another has) loses its out-edges; what the topics don't reach then goes."""
    into, out = defaultdict(list), defaultdict(list)
    for e in edges:
        into[e.dst].append(e.score)
        out[e.src].append(e.score)
    held = [n for n in sorted(answers) if into[n]]
    held = [n for n in held if n not in topics] or held
    if not held:
        return {e.eid for e in edges}
    plus = lambda xs: sum(max(0.0, x) for x in xs)
    end = max(held, key=lambda n: (max(into[n]), plus(into[n]), -len(out[n]), -plus(out[n])))
    return {e.eid for e in within_reach([e for e in edges if e.src != end], topics)[1]}


def attach_answers(edges: list[Edge], chosen: set[int], answers: set[int], max_edges: int) -> set[int]:
    """Each answer node without a chosen in-edge gets its best one that closes no cycle; where the graph is full it takes the place of the worst edge that isn't into an answer."""
    kept = set(chosen)
    by_id = {e.eid: e for e in edges}
    for node in sorted(answers):
        if any(by_id[k].dst == node for k in kept):
            continue
        board = Board(edges, [])
        board.on = np.isin(board.eid, np.array(sorted(kept), np.int64))
        for row in np.flatnonzero(board.dst == np.searchsorted(board.names, node)).tolist() if node in board.names else ():
            if board.closes(row):
                continue
            if len(kept) >= max_edges:
                free = [k for k in kept if by_id[k].dst not in answers]
                if not free:
                    break
                kept.discard(min(free, key=lambda k: (by_id[k].score, k)))
            kept.add(int(board.eid[row]))
            break
    return kept


def iterative(edges: list[Edge], topics: list[int], steps: int, memory: float) -> set[int]:
    """Step by step the best edge that begins where the walk has been; an edge scores ``memory`` more for each of the last three whose end it begins at."""
    there, taken = set(topics), []
    for _ in range(steps):
        recent = [e.dst for e in taken[-3:]]
        options = [e for e in edges if e.src in there and e not in taken]
        if not options:
            break
        best = max(options, key=lambda e: (e.score + memory * recent.count(e.src), -e.eid))
        taken.append(best)
        there.add(best.dst)
    return {e.eid for e in taken}


#: Ways to pick a question's edges, by name; a strategy takes edges and topics and gives the ids that stay.
STRATEGIES: dict[str, Callable[[list[Edge], list[int]], set[int]]] = {
    "all": lambda edges, _: {e.eid for e in edges},
    "budgeted": lambda edges, topics: build_dag(edges, topics, Budget()),
    "select": lambda edges, topics: budgeted_select(edges, topics, Budget()),
    "connected": lambda edges, topics: connected_first(edges, topics, Budget().max_edges),
    "beam": lambda edges, _: two_way_beam(edges, 2, 3, 3, Budget().max_edges),
    "tree": lambda edges, topics: steiner_edges(edges, topics, 3),
    "steps": lambda edges, topics: iterative(edges, topics, 6, 0.2),
}
