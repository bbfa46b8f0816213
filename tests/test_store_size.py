"""What a build of a store leaves on disk, and its ids against plain Python."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import store
from lattica.operators.graph import maybe_among
from lattica.session import cut, ensure_checkpoint_dir, saved, saved_in_slices

N = 20_000
SCHEMA = "dataset_id string, sample_id string, source_index long, triple_index int, triple_type string, subject string, predicate string, object string, title string"


def rows():
    draw = random.Random(3)
    name = lambda: draw.choice(("Item %d", "ITEM %d", "Item  %d ")) % draw.randrange(N // 3)
    out = [(draw.choice("ab"), f"s{i}", i, i % 3, draw.choice(("RELATION", "ATTRIBUTE")), name(), draw.choice(("owns", "Owns")), name(), "t") for i in range(N)]
    draw.shuffle(out)
    return out


def test_build_is_small_and_in_order(spark):
    raw = rows()
    left = lambda: sum(f.stat().st_size for f in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())
    built, before = store.Store(spark.createDataFrame(raw, SCHEMA).repartition(7)), left()
    got = {name: getattr(built, name) for name in built.TABLES}
    # a hash in letters for each pair and each triple alone would be 64 bytes, and more than one of them stood in several tables
    assert (left() - before) / N < 300

    tidy = [(d, s, i, t, kind, " ".join(a.split()), p, " ".join(b.split())) for d, s, i, t, kind, a, p, b, _ in sorted(raw, key=lambda r: (r[0], r[2], r[3]))]
    nodes, triples, kvs = {}, {}, {}
    for _, _, _, _, kind, a, p, b in tidy:
        for end in (a, b):
            nodes.setdefault(end.lower(), (len(nodes) + 1, end))
        triples.setdefault((kind, a.lower(), p.lower(), b.lower()), (len(triples) + 1, p))
        for k, v in [(f"{a} {p}", b), (f"the entity that {p} {b} is", a)][: 2 if kind == "RELATION" else 1]:
            kvs.setdefault((k.lower(), v), (len(kvs), k))
    assert {r.canonical_key: (r.node_id, r.canonical_name) for r in got["nodes"].collect()} == nodes
    assert {(r.triple_id, r.subject_id, r.predicate, r.object_id) for r in got["triples"].collect()} == {(n, nodes[a][0], p, nodes[b][0]) for (_, a, _, b), (n, p) in triples.items()}
    assert {(r.kv_offset, r.key_text, r.value_text) for r in got["kv_records"].collect()} == {(n, k, v) for (_, v), (n, k) in kvs.items()}
    assert got["triple_kvs"].agg(F.count_distinct("triple_id"), F.count_distinct("kv_offset")).first() == (len(triples), len(kvs))
    assert built.triples.where("length(content_key) != 64").isEmpty() and built.kv_records.where("length(content_key) != 64").isEmpty()


def test_nodes_and_triples_keep_no_hashes(spark):
    left = lambda: sum(f.stat().st_size for f in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    built = store.Store(spark.createDataFrame(rows(), SCHEMA).repartition(7))
    parsed, before = built.laid.count(), left()
    assert built.nodes.count() and built.triples.count()
    # a hash for each triple alone would be 32 bytes
    assert (left() - before) / parsed < 32
    # aliases come from the forms that the nodes were made of, not from the triples again
    plan = store.aliases(built.forms, built.nodes)
    assert not any("/laid-" in f for f in plan.inputFiles()) and any("/forms-" in f for f in plan.inputFiles())


def test_plain_texts_take_the_short_way_to_the_same_keys(spark):
    odd = ["", " ", "a", " a", "a  b", "a\n", "a\u00a0b", "A#1", "#", "((", "A (b) c", "(b)", "Kelvin \u212a", "\u0130x", "Stra\u00dfe", "a\u200bb", "x)", "-", "A-B c.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    # a mark that is no printable ASCII, taken off again, sends every text the long way
    marked = F.concat(F.coalesce("t", F.lit("")), F.lit("\u200b"))
    got = df.select("t", text.normalize_text("t"), text.canonical_entity_key("t"), text.casefold("t"), text.normalize_text(marked), text.canonical_entity_key(marked)).collect()
    for t, norm, key, low, long_norm, long_key in got:
        assert (norm, key) == (long_norm, long_key) and low == (t or "").casefold(), t


def test_sources_come_by_place_and_pairs_of_both_directions_meet(spark):
    # a forward pair that equals a backward one, copies in other letters and of other samples, and the same source twice
    odd = [("a", "s1", 5, 0, "RELATION", "x y", "Owns", "b"), ("a", "s2", 1, 0, "ATTRIBUTE", "The entity that owns B", "is", "x y"), ("a", "s1", 5, 1, "RELATION", "X Y", "owns", "b"), ("a", "s1", 6, 0, "RELATION", "x y", "Owns", "b"), ("b", "s1", 6, 0, "RELATION", "x", "y Owns", "b"), ("b", "s3", 7, 2, "ATTRIBUTE", "The", "is", "that")]
    raw = [(*r, "t") for r in odd] + [r for r in rows()[:3000] if r[0] == "a" or r[2] > 10]
    built = store.Store(spark.createDataFrame(raw, SCHEMA).repartition(5))
    kvs, triples, sources, links, origins = {}, {}, set(), {}, set()
    for d, s, i, t, kind, a, p, b, _ in sorted(raw, key=lambda r: (r[0], r[2], r[3])):
        a, b = " ".join(a.split()), " ".join(b.split())
        n = triples.setdefault((kind, a.lower(), p.lower(), b.lower()), len(triples) + 1)
        origins.add((n, d, s, t))
        for side, (k, v) in enumerate([(f"{a} {p}", b), (f"the entity that {p} {b} is", a)][: 2 if kind == "RELATION" else 1]):
            kv = kvs.setdefault((k.lower(), v), len(kvs))
            sources.add((kv, d, s, t, side))
            links[n, kv] = min(side, links.get((n, kv), side))
    got = sorted(map(tuple, built.kv_sources.collect()))
    assert got == sorted(sources)
    assert {(r.triple_id, r.kv_offset): r.ordinal for r in built.triple_kvs.collect()} == links
    assert sorted(map(tuple, built.triple_sources.select("triple_id", "dataset_id", "sample_id", "triple_index").collect())) == sorted(origins)
    # no hash of a pair is computed for its sources, let alone exchanged
    assert "sha2" not in built.kv_sources._jdf.queryExecution().toString()


def test_keys_are_written_once_and_only_copies_look_for_their_first(spark, monkeypatch):
    raw = [("a", "s1", 1, 0, "RELATION", "A#1 (x)", "Owns", "Kelvin \u212a"), ("a", "s1", 1, 1, "RELATION", "a 1", "owns", "kelvin k"), ("a", "s2", 2, 0, "ATTRIBUTE", "A 1", "is", "(b)")]
    built = store.Store(spark.createDataFrame([(*r, "t") for r in raw] + [("b", "s9", 0, 0, "ATTRIBUTE", "A 1", "is", "(b)", "")], SCHEMA))
    assert [tuple(r) for r in built.laid.orderBy("pos").select("s_key", "o_key").collect()] == [("a 1", None), (None, None), (None, "symbol:"), (None, "symbol:")]
    asked = []
    monkeypatch.setattr(store, "canonical_entity_key", lambda c: asked.append(c))
    assert [r.triple_id for r in built.triple_ids.orderBy("pos").collect()] == [1, 1, 2, 2] and built.triples.count() == 2
    assert not asked and "sha2" not in built.triple_ids._jdf.queryExecution().toString()
    assert {r.triple_id: r.title for r in built.titles.collect()} == {1: "t", 2: "t"}


def test_shuffle_files_go_when_a_table_is_written(spark):
    dirs = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    left = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before = left()
    df = spark.range(100_000).repartition(3).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    table = saved(df, "counts")
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_large_builds_meet_their_nodes_in_slices(spark, monkeypatch):
    raw = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    whole, large = store.Store(raw), store.Store(raw)
    expected = sorted(map(tuple, whole.triples.collect()))
    sizes: dict[str, list[int]] = {}

    def counted(part, slices, name):
        sizes[name] = [part(k).count() for k in range(slices)]
        return saved_in_slices(part, slices, name)

    monkeypatch.setattr(store, "SLICED_FROM", 1_000)
    monkeypatch.setattr(store, "saved_in_slices", counted)
    assert sorted(map(tuple, large.triples.collect())) == expected
    # no slice holds half of the triples, and together they hold each once
    assert sum(sizes["met"]) == len(expected) and max(sizes["met"]) < len(expected) / 2 and len(sizes["places"]) > 1
    # what lay between the two steps is gone
    assert not list(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("met-*"))


def test_shuffle_files_go_at_a_checkpoint(spark):
    dirs = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    left = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before = left()
    table = cut(spark.range(100_000).repartition(3).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before and table.count() == 1000


def test_only_edges_of_a_frontier_may_move(spark):
    edges = spark.range(200_000).select((F.col("id") % 50_000).alias("node_id"), F.col("id").alias("triple_id"))
    frontier = spark.range(0, 50_000, 100).select(F.col("id").alias("node_id"))
    got = maybe_among(edges, frontier)
    assert got.columns == edges.columns and got.join(frontier, "node_id").count() == 2_000
    # eight million bits let few others pass
    assert got.count() < 2_100
