"""Near-duplicate groups by a chosen-path similarity join over word shingles.

1. Every text becomes its set of distinct k-word shingles (64-bit hashes), of
   which a row keeps the size, a 128-bit fingerprint of the whole set and a
   signature of minwise values. Equal sets are one vertex from here on.
2. Stars: in each of a few trees a vertex chooses the path of one minwise token
   and meets the pivots of the path (three of its vertices, of like size). It is
   compared with the pivots it agrees with best. Confirmed links are contracted,
   which takes large groups of copies down to a few components in a number of
   pairs proportional to their size.
3. Trees: independent trees branch vertices by chosen minwise tokens. A node
   whose vertices are all in one component is done. A node of at most ``leaf``
   vertices, or of at most so many outside its largest component, is compared
   exhaustively across components (the largest component in blocks of ``leaf``).
   Any other node branches again, by 1 / threshold tokens on average. Nodes that
   are still large at the last depth are compared exhaustively in blocks, too. A
   vertex with many shingles counts as several, so a leaf's sets fit a task.
4. In a leaf, vertices that a signature puts near one of another component get
   their full sets, and links are counted out on these; only links that join
   components leave the leaf. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.pieces import ragged_take
from lattica.llm.textscan import SPACES, U64, Words, as_batches, fixed_bytes, map_arrow, mix, slices, text_bytes
from lattica.operators.components import connected_components
from lattica.session import cut

#: Minwise values in a signature, each kept as 8 bits; those of them that leaves and stars compare, kept as 4 bits, two to a byte; and those kept as 16 bits to choose paths by.
MINWISE, LEAF, SHORT, PATHS = 256, 128, 64, 64
#: Shingles of a vertex that count as one.
UNIT = 1000
#: The largest nodes of a level, so many, are joined by broadcast.
HOT = 1000
#: Chance that a pair at the threshold whose nodes stay large is compared at the last level.
RECALL = 0.999
_odd = np.random.default_rng(7).integers(0, 2**63, MINWISE, dtype=np.uint64) * U64(2) + U64(1)


def least_agree(percent: int, values: int, bits: int = 8) -> float:
    """Lowest share of equal minwise values at which a pair is still a candidate: 4.5 standard deviations below the threshold, chance agreement of few bits included."""
    p = percent / 100
    p += (1 - p) / 2**bits
    return p - 4.5 * (p * (1 - p) / values) ** 0.5


def survival(percent: int, level: int) -> float:
    """The chance that a tree keeps a pair at the threshold together down to ``level``: one token at the root, then one and a share of a second."""
    p, second = percent / 100, min(1.0, (10_000 // percent - 100) / 100)
    kept = p
    for _ in range(level - 1):
        kept = p * (1 - (1 - kept) * (1 - second * kept))
    return kept


def trees_for(percent: int, depth: int, recall: float = RECALL) -> int:
    """Trees that keep a pair at the threshold together down to the last level in at least one with chance ``recall``."""
    lost = 1 - survival(percent, depth)
    return 1 if lost < 1e-9 else ceil(log(1 - recall) / log(lost))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    data, offsets = text_bytes(column)
    words = Words(data, offsets, SPACES)
    hashes = words.hashes()
    first, grams = words.grams(hashes, k)
    ends = np.searchsorted(first, words.bounds)
    sets = []
    for i in range(words.n_docs):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= k:
            sets.append(np.unique(grams[ends[i] : ends[i + 1]]))
        elif b > a:
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            sets.append(mix(mix(hashes[a:b] + place).sum(dtype=np.uint64, keepdims=True) + U64(int(b - a))))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The smallest values of a set under MINWISE hash functions: 8 bits of each, 4 bits of the first LEAF, and 16 bits of the first PATHS."""
    least = np.full(MINWISE, U64(2**64 - 1))
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[k : k + 1024, None] * _odd).min(0), out=least)
    least = mix(least)
    full = (least >> U64(56)).astype(np.uint8)
    return full.tobytes(), (full[:LEAF:2] & 0xF0 | full[1:LEAF:2] >> 4).tobytes(), (least[:PATHS] >> U64(32)).astype("<u2").tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values of each two rows of packed 4-bit values are equal."""
    apart = a ^ b
    return ((apart & 0xF0) == 0).sum(1) + ((apart & 0x0F) == 0).sum(1)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (fingerprint of the set), sig, packed and tokens of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sig", pa.binary()), ("packed", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                fp1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                fp2 = np.array([mix(s + U64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                signed = [signature(s) for s in sets]
                yield from as_batches([{"doc_id": part.column("doc_id"), "n_shingles": [len(s) for s in sets], "fp1": fp1, "fp2": fp2, "sig": [x[0] for x in signed], "packed": [x[1] for x in signed], "tokens": [x[2] for x in signed]}], schema)

    return map_arrow(needed(docs, doc_id="long", text="string"), run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, packed binary, tokens binary")


def _path(tree: F.Column, place: F.Column) -> F.Column:
    """The minwise value at a place of the path tokens (2 bytes), with its tree and place, as a node key."""
    return F.xxhash64(tree, place, F.substring(F.col("tokens"), place * 2 + 1, 2))


def _agreeing(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out the threshold."""
    side = lambda x: vertices.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (fixed_bytes(batch.column(c), MINWISE) for c in ("sig_a", "sig_b"))
                near = pa.array((x == y).mean(1) >= least_agree(percent, MINWISE))
                yield batch.select(["a", "b"]).filter(near).cast(schema)

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long")


#: Bits of a filter of ids: 256 bitmaps of 32,768 bits, a MB however many ids there are.
FILTER_BITS = 256 * 32768


def marked_ids(df: DataFrame, column: str, ids: DataFrame, name: str, mark: str) -> DataFrame:
    """Add ``mark``: whether ``column`` may be among ``ids``. False is certain; a null id isn't among them.

    The filter has a bounded size. With very many ids it lets most rows pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = ids.select(place(name).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("_bits", (F.expr("_pos div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumns({"_bucket": F.bitmap_bucket_number(place(column)), "_pos": at}).join(F.broadcast(bits), "_bucket", "left")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_pos % 8 as int))")) != 0, F.lit(False))
    return met.withColumn(mark, hit & F.col(column).isNotNull()).drop("_bucket", "_pos", "_bits")


def with_ids_of(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``ids``: spares a join's shuffle the rows that can't match; the join alone decides."""
    return marked_ids(df, column, ids, name, "_maybe").where("_maybe").drop("_maybe")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets overlap enough: 100 * common >= percent * all."""
    texts = needed(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    pairs = cut(pairs)
    left = with_ids_of(texts, "doc_id", pairs, "a").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = with_ids_of(texts, "doc_id", pairs, "b").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                keep = []
                for x, y in zip(shingle_sets(part.column("text_a"), k), shingle_sets(part.column("text_b"), k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).cast(schema)

    return map_arrow(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def _with_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows joined with their nodes, a row each.

    The HOT nodes of most rows go out by broadcast, so their rows stay where they
    are; a node that is left for the shuffle has at most one row in HOT of all.
    """
    most = rows.groupBy("node").agg(F.count("*").alias("_rows")).where("_rows > 1").orderBy(F.desc("_rows"), "node").limit(HOT)
    hot = F.broadcast(cut(most.select("node")))
    large = rows.join(F.broadcast(nodes.join(hot, "node")), "node")
    return large.unionByName(rows.join(hot, "node", "left_anti").join(nodes, "node"))


def _spokes(on_path: DataFrame, percent: int) -> DataFrame:
    """For each vertex, the two pivots on its paths that its short signature agrees with best, where they agree enough."""
    here = F.struct("id", "short")
    pivots = F.array_distinct(F.array(F.min(here), *[F.min_by(here, F.xxhash64("id", F.lit(k))) for k in (1, 2)]))
    middle = on_path.groupBy("node").agg(pivots.alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = _with_nodes(on_path, middle).select(F.col("id").alias("a"), "short", F.explode("m").alias("p")).select("a", F.col("p.id").alias("b"), "short", F.col("p.short").alias("other")).where("a != b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = agreeing(*(fixed_bytes(batch.column(c), SHORT // 2) for c in ("short", "other")))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree, pa.int64())], schema=schema).filter(pa.array(agree >= SHORT * least_agree(percent, SHORT, 4)))

    near = map_arrow(met, run, "a long, b long, agree long")
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("agree")).alias("worse"), "b"))), 1, 2).alias("best"))
    return best.select("a", F.explode("best.b").alias("b"))


_MEMBERS = ("id", "comp", "n", "side")


def _laid_by_leaf(members: DataFrame) -> DataFrame:
    """Members (with node) dealt by leaf, the members of a leaf one after another; a sort that spills, and no row is larger than a member."""
    return members.repartition("node").sortWithinPartitions("node", "id")


def _whole_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut where leaves end, with the place after each row's leaf; the leaf a batch ends in waits for the next one."""
    rest: pa.RecordBatch | None = None

    def with_ends(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        node = batch.column("node").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
        return batch, np.repeat(edges[1:], np.diff(edges))

    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if batch.num_rows:
            node = batch.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last:
                yield with_ends(batch.slice(0, last))
            rest = batch.slice(last)
    if rest is not None and rest.num_rows:
        yield with_ends(rest)


def _comparable(batch: pa.RecordBatch, percent: int):
    """ids, comp and n of a batch's rows, and for rows i and j of a leaf whether they are compared: other components, like sizes, other sides."""
    ids, comp, n, side = (batch.column(c).to_numpy() for c in _MEMBERS)

    def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (comp[j] != comp[i]) & ((side[j] != side[i]) | (side[j] < 0)) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))

    return ids, comp, n, compared


def _near_members(members: DataFrame, percent: int) -> DataFrame:
    """node, id, comp, n and side of the members (with packed) whose signature is near that of one of their leaf they are compared with."""
    least = LEAF * least_agree(percent, LEAF, 4)
    schema = pa.schema([(c, pa.int64()) for c in ("node", *_MEMBERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, end in _whole_leaves(batches):
            _, _, _, compared = _comparable(batch, percent)
            packed = fixed_bytes(batch.column("packed"), LEAF // 2)
            near = np.zeros(len(end), bool)
            # all pairs of all leaves, by how far apart the two stand
            apart, i = 1, np.flatnonzero(end > np.arange(len(end)) + 1)
            while len(i):
                j = i + apart
                ok = np.flatnonzero(compared(i, j))
                ok = ok[agreeing(packed[i[ok]], packed[j[ok]]) >= least]
                near[i[ok]] = near[j[ok]] = True
                apart += 1
                i = i[end[i] > i + apart]
            yield batch.select(schema.names).filter(pa.array(near)).cast(schema)

    return map_arrow(_laid_by_leaf(members), run, "node long, " + ", ".join(f"{c} long" for c in _MEMBERS))


def _full_sets(members: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id and set (shingle hashes, cut to 32 bits) of the texts of vertices that may be among the given ones."""
    texts = with_ids_of(needed(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "id"), "id", members, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [s.astype("<u4").tobytes() for s in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    return map_arrow(texts, run, "id long, set binary")


def _leaf_links(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a leaf whose sets overlap enough; pairs in components that such a pair joins already are left out.

    Sets of 32-bit hashes can only overlap more than the full ones, so no link is
    missed; the few pairs that come out are confirmed on full sets.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of_leaf(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], compared) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(x) for x in sets])
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        by = np.argsort(number, kind="stable")
        held, bounds = owner[by], np.searchsorted(number[by], np.arange(number.max(initial=-1) + 2))
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in range(len(sizes) - 1):
            j = compared(i)
            if not len(j):
                continue
            others, _ = ragged_take(held, bounds, number[ends[i] : ends[i + 1]])
            common = np.bincount(others, minlength=len(sizes))[j]
            for x in j[(common > 0) & (100 * common >= percent * (n[j] + n[i] - common))].tolist():
                a, b = top(int(comp[i])), top(int(comp[x]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield int(ids[i]), int(ids[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, end in _whole_leaves(batches):
            ids, comp, n, compared = _comparable(batch, percent)
            column, found, first = batch.column("set"), [], 0
            while first < len(end):
                last = int(end[first])
                if (comp[first:last] != comp[first]).any():
                    sets = [np.frombuffer(x.as_buffer(), "<u4") for x in column.slice(first, last - first)]
                    after = lambda i, a=first, b=last: np.flatnonzero(compared(np.int64(a + i), np.arange(a + i + 1, b))) + i + 1
                    found += of_leaf(ids[first:last], comp[first:last], n[first:last], sets, after)
                first = last
            both = np.array(found, np.int64).reshape(-1, 2)
            yield from as_batches([{"a": both[:, 0], "b": both[:, 1]}], schema)

    return map_arrow(_laid_by_leaf(members), run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int | None = None, star_trees: int = 4, leaf: int = 2048, depth: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Texts are linked when 100 * common >= percent * all over their distinct
    k-word shingles (A-Z lower-cased, words split at ASCII white space; fewer than
    k words count as one shingle). component_id is the smallest doc_id reachable
    over links, kept says that it is the row's own. A null, empty or blank text has
    no shingles and no links. A row without doc_id takes no part: its component_id
    is null and it is kept. Repeated rows fall into one component; a doc_id that
    comes with several texts is one vertex with the links of each. The number of
    ``trees`` follows from depth and RECALL when none is given.
    """
    trees = trees or trees_for(percent, depth)
    sketched = cut(sketch(docs, k))
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    sets = some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("sig", "packed", "tokens")])
    vertices = cut(sets.select("id", F.col("n_shingles").alias("n"), "sig", "packed", "tokens", "fp1", "fp2"))

    tree = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tree")
    # stars, by tree, token and size class
    size_class = F.floor(F.log("n") / F.log(F.lit(1.25)))
    on_path = vertices.select("id", "n", "tokens", F.substring("packed", 1, SHORT // 2).alias("short"), tree(star_trees)).select("id", "short", F.xxhash64(_path(F.col("tree"), F.col("tree")), size_class).alias("node"))
    links = confirm(_agreeing(_spokes(on_path, percent), vertices, percent), docs, k, percent)
    first = connected_components(links, "a", "b")
    # trees
    with_comp = cut(vertices.join(first.withColumnsRenamed({"node": "id", "component": "comp"}), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "n", "packed", "tokens"))
    weight = F.ceil(F.col("n") / UNIT)
    at = with_comp.select("id", "comp", weight.alias("w"), F.explode(F.array(*[_path(F.lit(t), F.lit(t)) for t in range(trees)])).alias("node"))
    members = None
    for level in range(1, depth + 1):
        by_comp = at.groupBy("node", "comp").agg(F.sum("w").alias("c"))
        sizes = by_comp.groupBy("node").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        sizes = sizes.select("node", "c", F.col("top.comp").alias("top"), (F.col("c") - F.col("top.c")).alias("outside"))
        at = cut(_with_nodes(at, sizes).select("node", "id", "c", "outside", (F.col("comp") == F.col("top")).alias("inside")))
        last = level == depth
        members = _union(members, at.where(F.col("c") <= leaf).select("node", "id", F.lit(-1).alias("side")))
        members = members.union(_against_largest(at.where((F.col("c") > leaf) & (F.col("outside") <= leaf)), leaf))
        big = at.where(F.col("outside") > leaf)
        if last:
            members = members.union(_blocks(big, leaf))
        if last or big.isEmpty():
            break
        # one more token always, and a second one for a share of the nodes: 1 / threshold on average
        places = F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PATHS)), F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(100)) < F.lit(10_000 // percent - 100), F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PATHS))))
        paths = big.groupBy("id").agg(F.flatten(F.collect_list(F.transform(F.filter(places, lambda x: x.isNotNull()), lambda x: F.struct("node", x.alias("place"))))).alias("paths"))
        chosen = paths.join(with_comp.select("id", "comp", weight.alias("w"), "tokens"), "id")
        children = F.transform("paths", lambda x: F.xxhash64(x["node"], x["place"], F.substring(F.col("tokens"), (x["place"] * 2 + 1).cast("int"), F.lit(2))))
        at = chosen.select("id", "comp", "w", F.explode(children).alias("node"))
    signed = members.join(with_comp.select("id", "comp", "n", "packed"), "id")
    near = cut(_near_members(signed, percent))
    more = confirm(_leaf_links(near.join(_full_sets(near, docs, k), "id"), percent).distinct(), docs, k, percent)
    comp_of = lambda x: with_comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    joined = more.join(comp_of("a"), "a").join(comp_of("b"), "b").select("ca", "cb")
    second = connected_components(joined, "ca", "cb")
    final = with_comp.join(second.withColumnsRenamed({"node": "comp"}), "comp", "left").select("id", F.coalesce("component", "comp").alias("component_id"))
    by_set = vertices.select("id", "fp1", "fp2", F.col("n").alias("n_shingles")).join(final.distinct(), "id").drop("id")
    out = sketched.drop("sig", "packed", "tokens").join(by_set, ["fp1", "fp2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.union(b)


def _against_largest(nodes: DataFrame, leaf: int) -> DataFrame:
    """Cut the largest component of each node into blocks of about ``leaf`` vertices; those outside it, few, go to each block."""
    n = F.ceil((F.col("c") - F.col("outside")) / leaf).cast("int")
    block = F.when(F.col("inside"), F.array(F.pmod(F.xxhash64("id"), n).cast("int"))).otherwise(F.sequence(F.lit(0), n - 1))
    dealt = nodes.select("node", "id", "inside", F.explode(block).alias("block"))
    side = F.when(F.col("inside"), 0).when(F.col("block") == 0, -1).otherwise(1)
    return dealt.select(F.xxhash64("node", "block").alias("node"), "id", side.alias("side"))


def _blocks(big: DataFrame, leaf: int) -> DataFrame:
    """Cut nodes into blocks of about half a leaf and make a leaf of each two blocks of a node.

    A vertex goes to as many leaves as its node has blocks. ``side`` keeps the two
    blocks of a leaf apart, so that each pair of a node is compared once.
    """
    n = F.ceil(F.col("c") * 2 / leaf).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    dealt = big.select("node", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    same = F.col("own") == F.col("other")
    return dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", F.when(same, -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
