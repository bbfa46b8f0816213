"""Searches and steps of variants on random graphs by property, budgets on toy stores, and the library without its optional part."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lattica.operators import reports, retrieval, variants
from lattica.operators import selection as s

ROOT = Path(__file__).resolve().parent.parent


def random_edges(seed, n=30, nodes=9):
    rng = random.Random(seed)
    return [s.Edge(k, rng.randrange(nodes), rng.randrange(nodes), round(rng.random(), 3)) for k in range(n)]


def acyclic(rows):
    out = {}
    for e in rows:
        out.setdefault(e.src, set()).add(e.dst)
    return not any(s.leads_to(out, e.dst, e.src) for e in rows)


@pytest.mark.parametrize("seed", range(20))
def test_searches(seed):
    rows = random_edges(seed)
    by_id = {e.eid: e for e in rows}
    assert set(variants.STRATEGIES) >= {"all", "budgeted", "tree"}
    for name, strategy in variants.STRATEGIES.items():
        kept = strategy(rows, [0])
        assert kept <= set(by_id), name
        assert strategy([], [0]) == set(), name
    assert len(variants.connected_first(rows, [0], 5)) == 5
    beam = [by_id[k] for k in variants.two_way_beam(rows, 2, 3, 3, 10)]
    assert acyclic(beam) and len(beam) <= 10
    steps = [by_id[k] for k in variants.iterative(rows, [0], 6, 0.2)]
    assert len(s.within_reach(steps, [0])[1]) == len(steps)
    groups = [{0, 1}, {4}, {7, 8}]
    tree = [by_id[k] for k in variants.group_steiner(rows, groups)]
    nodes = {n for e in tree for n in (e.src, e.dst)}
    assert not tree or all(g & nodes for g in groups) and len(tree) == len(nodes) - 1
    ends = variants.answers_at_ends(rows, [0], {3, 5})
    assert any(not any(by_id[k].src == a for k in ends) for a in (3, 5)) or not any(e.dst in (3, 5) for e in rows)
    chosen = s.build_dag(rows, [0], s.Budget())
    attached = [by_id[k] for k in variants.attach_answers(rows, chosen, {3, 5}, 16)]
    assert acyclic(attached) and len(attached) <= max(16, len(chosen))


def test_attached_answer_takes_the_worst_place():
    rows = [s.Edge(0, 0, 1, 0.9), s.Edge(1, 0, 2, 0.1), s.Edge(2, 1, 5, 0.5)]
    assert variants.attach_answers(rows, {0, 1}, {5}, 2) == {0, 2}
    assert variants.attach_answers(rows, {0, 1}, {5}, 9) == {0, 1, 2}


INCIDENT = "node_id long, triple_id long, other_id long, rank int"


def test_budget_stops_before_the_last_far_end(spark):
    """A hub with three leaves, one of which leads on: with two triples the second one's end isn't expanded."""
    rows = [(1, 10, 2, 1), (1, 11, 3, 2), (1, 12, 4, 3), (3, 13, 5, 1), (2, 14, 6, 1)]
    seeds = spark.createDataFrame([(0, 1)], "qid long, seed long")
    expand = lambda hops, most: [r.triple_id for r in retrieval.expand_budgeted(seeds, spark.createDataFrame(rows, INCIDENT), hops, most).orderBy("n").collect()]
    assert expand(1, 2) == [10, 11] and expand(2, 2) == [10, 11]
    assert expand(2, 4) == [10, 11, 12, 14] and expand(2, 9) == [10, 11, 12, 14, 13]


def test_fill_is_whole_and_apart(spark):
    hits = spark.createDataFrame([(q, n, n + 1) for q in range(30) for n in range(3)], "qid long, node_id long, rank int")
    got = retrieval.with_fill(hits, spark.range(20).withColumnRenamed("id", "node_id"), 5).collect()
    for q in range(30):
        own = [r for r in got if r.qid == q]
        assert len(own) == 8 and len({r.node_id for r in own}) == 8 and sorted(r.rank for r in own) == list(range(1, 9))
    assert retrieval.with_fill(hits, spark.range(4).withColumnRenamed("id", "node_id"), 5).count() == 30 * 4


def test_prizes_and_folds(spark):
    scored = spark.createDataFrame([(1, k, x) for k, x in enumerate([0.9, 0.9, 0.5, 0.1])], "qid long, eid long, score double")
    got = [round(r.prize, 6) for r in reports.level_prizes(scored, ["qid"], "score", 2).orderBy("eid").collect()]
    assert got == [1.0, 1.0, 0.99, 0.0]
    tails = spark.createDataFrame([(1, 0, "a"), (1, 1, "b, a"), (1, 2, "c"), (2, 0, "x" * 60), (2, 1, "y")], "k long, o long, t string")
    assert {r.k: r.t for r in reports.fold_tails(tails, ["k"], "t", "o").collect()} == {1: "a, b, c", 2: "x" * 60}


def test_another_length_stops_the_job(spark):
    have = spark.createDataFrame([(0, [1.0, 2.0])], "kv_offset long, embedding array<double>")
    new = spark.createDataFrame([(5, [1.0])], "k long, embedding array<double>")
    with pytest.raises(Exception, match="another length"):
        variants.append_vectors(have, new, "k").collect()


def test_the_rest_works_without_the_text_operators(tmp_path):
    """What the library and its queries are without the optional subpackage, its tests and the pipeline."""
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=away)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", check=True, timeout=120)
