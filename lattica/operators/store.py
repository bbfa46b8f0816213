"""Content-addressed key/value and graph tables, built as sets.

Identity is a hash of normalised content; ids are ranks of first occurrence in a
total order, so a build gives the same tables however its input is partitioned.
Parsed triples are sorted by ranges once and written with their place, one number.
From then on places stand for the order: groups carry a hash and a place, ranks are
counted in stretches of places, and texts come back by their place, so no exchange
carries texts that a later one drops. Keys of names are computed once and written where
they aren't just the name in lower case; hashes are expressions of the texts and computed
where they are needed, as they take more room than what they are made of.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.text import canonical_entity_key, casefold, normal_hash, normalize_text
from lattica.operators.graph import maybe_among
from lattica.session import discard, saved, saved_in_slices

ORDER = ("dataset_id", "source_index", "triple_index")
#: In how many slices the triples of a large build meet their nodes, one after another, and from how many parsed triples on.
SLICES, SLICED_FROM = 3, 1_000_000


def parsed(raw: DataFrame) -> DataFrame:
    """Normalised triples of the two types with no empty field."""
    t = raw.withColumns({"triple_type": F.upper(normalize_text("triple_type")), **{c: normalize_text(c) for c in ("subject", "predicate", "object")}})
    return t.where(F.col("triple_type").isin("RELATION", "ATTRIBUTE") & (F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != ""))


def keyed(t: DataFrame) -> DataFrame:
    """Parsed triples with the keys of both ends and the content key of the triple."""
    return with_keys(t).withColumn("content_key", _content_key())


def with_keys(t: DataFrame) -> DataFrame:
    """Parsed triples with the keys of both ends; laid ones have those that aren't the name in lower case."""
    if "s_key" in t.columns:
        return t.withColumns({"s_key": F.coalesce("s_key", F.lower("subject")), "o_key": F.coalesce("o_key", F.lower("object"))})
    return t.withColumns({"s_key": canonical_entity_key("subject"), "o_key": canonical_entity_key("object")})


def _content_key() -> Column:
    """content_hash of type, keys and relation; only the keys of symbols may not be normalised yet."""
    return normal_hash("triple_type", normalize_text("s_key"), casefold("predicate"), normalize_text("o_key"))


def forward_key(subject: Column, predicate: Column) -> Column:
    return F.concat_ws(" ", subject, predicate)


def default_kvs(t: DataFrame) -> DataFrame:
    """Key/value pairs of each triple: forward, and for a RELATION backward."""
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    pair = lambda k, v: F.struct(k.alias("key_text"), v.alias("value_text"))
    forward = pair(forward_key(s, p), o)
    backward = pair(F.concat(F.lit("the entity that "), p, F.lit(" "), o, F.lit(" is")), s)
    both = F.when(F.col("triple_type") == "RELATION", F.array(forward, backward)).otherwise(F.array(forward))
    return t.select("*", F.posexplode(both).alias("kv_index", "kv")).select("*", "kv.key_text", "kv.value_text").drop("kv")


def templated_kvs(t: DataFrame, typed: bool = False) -> DataFrame:
    """Two-way pairs by template, or with ``typed`` keys of the form type|subject|relation."""
    s, p, o, kind = F.col("subject"), F.col("predicate"), F.col("object"), F.col("triple_type")
    forward = F.concat_ws("|", kind, s, p) if typed else F.when(kind == "ATTRIBUTE", F.concat(F.lit("the "), p, F.lit(" of "), s, F.lit(" is"))).otherwise(forward_key(s, p))
    backward = F.concat_ws("|", kind, o, p) if typed else F.when(kind == "ATTRIBUTE", F.concat(o, F.lit(" is the "), p, F.lit(" of"))).otherwise(F.concat(F.lit("the entity that "), p, F.lit(" "), o, F.lit(" is")))
    pairs = F.array(F.struct(forward.alias("key_text"), o.alias("value_text")), F.struct(backward.alias("key_text"), s.alias("value_text")))
    return t.select("*", F.posexplode(pairs).alias("kv_index", "kv")).select("*", "kv.key_text", "kv.value_text").drop("kv")


def _ord(*more: str) -> Column:
    return F.struct(*ORDER, *more)


def kv_keyed(kvs: DataFrame) -> DataFrame:
    """Key/value pairs with the content key of the pair; pairs of parsed triples are normalised as they are."""
    return kvs.withColumn("kv_key", normal_hash(casefold("key_text"), "value_text"))


def short(key: Column | str) -> Column:
    """The first 16 bytes of a content key, by which rows of a build meet: half of SHA-256 still tells all contents apart and is a quarter of the key's letters."""
    return F.substring(F.unhex(key), 1, 16)


def laid(t: DataFrame) -> DataFrame:
    """Parsed triples with pos, a number that grows in the order of the build, unique, with gaps, and with the keys of both ends
    (s_key, o_key; null where a key is the name in lower case). Written once, as two readings number differently."""
    placed = with_keys(t.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id()))
    return saved(placed.withColumns({"s_key": F.nullif("s_key", F.lower("subject")), "o_key": F.nullif("o_key", F.lower("object"))}), "laid")


def _ranked(firsts: DataFrame, name: str, start: int, slices: int = 1) -> DataFrame:
    """Add the rank of ``place`` (unique), counting from ``start``; the rows are written in its order.

    Places are counted within stretches of 2**17; the sums of the stretches, a row
    for each, are added up apart. With ``slices`` the stretches are dealt over so many
    jobs, which each read ``firsts``.
    """
    placed = firsts.withColumn("_stretch", F.shiftright("place", 17))
    own = F.row_number().over(Window.partitionBy("_stretch").orderBy("place"))
    return _summed(saved_in_slices(lambda k: _slice(placed, "_stretch", k, slices).withColumn("_n", own), slices, "places"), name, start)


def _slice(df: DataFrame, column: str, k: int, slices: int) -> DataFrame:
    """The rows whose value of a column is dealt to slice ``k``."""
    return df.where(F.pmod(F.xxhash64(column), F.lit(slices)) == k) if slices > 1 else df


def _summed(counted: DataFrame, name: str, start: int) -> DataFrame:
    """Ranks of rows counted within stretches (_stretch, _n), from ``start``."""
    sizes = counted.groupBy("_stretch").agg(F.max("_n").cast("long").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = counted.join(F.broadcast(saved(sizes.select("_stretch", before.alias("_before")), "stretches")), "_stretch")
    return met.withColumn(name, F.col("_before") + F.col("_n") + (start - 1)).drop("_stretch", "_n", "_before")


def _numbered(links: DataFrame, name: str, start: int) -> DataFrame:
    """place, own (it is the first of its kind) and the rank of its first, from ``start``, of all places of links (place, first). Each is counted in its first's stretch, right after it."""
    stretch, own = F.shiftright("first", 17), F.col("place") == F.col("first")
    so_far = Window.partitionBy("_stretch").orderBy("first", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = links.withColumn("_stretch", stretch).withColumn("_n", F.count_if(own).over(so_far))
    return _summed(saved(counted.select("place", own.alias("own"), "_stretch", "_n"), "places"), name, start)


def pair_numbers(t: DataFrame) -> DataFrame:
    """place (pos * 2 + kv_index), own and kv_offset (from 0, by first occurrence) of all pairs of laid triples.

    Pairs meet by a number of 64 bits. One that no other pair shares is a pair's own;
    only pairs that share theirs are compared by their content keys.
    """
    placed = lambda df: default_kvs(df.select("pos", "triple_type", "subject", "predicate", "object")).withColumn("place", F.col("pos") * 2 + F.col("kv_index"))
    met = placed(t).select("place", F.xxhash64(casefold("key_text"), "value_text").alias("_h"))
    same = Window.partitionBy("_h")
    counted = saved(met.withColumn("_shared", F.min("place").over(same) != F.max("place").over(same)).select("place", F.when(F.col("_shared"), F.col("_h")).alias("_h")), "met_pairs")
    links = counted.where("_h IS NULL").select("place", F.col("place").alias("first"))
    shared = counted.where("_h IS NOT NULL")
    if not shared.isEmpty():
        at = shared.select(F.shiftright("place", 1).alias("pos")).distinct()
        texts = kv_keyed(placed(maybe_among(t, at, "pos").join(at, "pos"))).select("place", short("kv_key").alias("_k"))
        exact = texts.join(shared, "place").select("place", F.min("place").over(Window.partitionBy("_h", "_k")).alias("first"))
        links = links.union(exact)
    numbers = _numbered(links, "kv_offset", 0)
    discard(counted)
    return numbers


def _offsets(numbers: DataFrame) -> DataFrame:
    """pos and offsets of its pairs, forward and backward; null where ``numbers`` has none."""
    pos, side = F.shiftright("place", 1), F.col("place").bitwiseAND(1)
    return numbers.groupBy(pos.alias("pos")).agg(*[F.max(F.when(side == i, F.col("kv_offset"))).alias(name) for i, name in enumerate(("_forward", "_backward"))])


def _of_pairs(known: DataFrame) -> DataFrame:
    """A row for each pair of rows with offsets: kv_index and kv_offset."""
    return known.select("*", F.posexplode(F.array("_forward", "_backward")).alias("kv_index", "kv_offset")).where("kv_offset IS NOT NULL").drop("_forward", "_backward")


def kv_records(t: DataFrame, numbers: DataFrame, *more: str) -> DataFrame:
    """kv_offset, key_text and value_text of the distinct pairs of laid triples; the first text wins. ``more`` columns are those of the first triple."""
    known = default_kvs(t.select("pos", "triple_type", "subject", "predicate", "object").join(_offsets(numbers.where("own")), "pos"))
    return known.select(F.when(F.col("kv_index") == 0, F.col("_forward")).otherwise(F.col("_backward")).alias("kv_offset"), "key_text", "value_text", *more).where("kv_offset IS NOT NULL")


def with_content_key(records: DataFrame) -> DataFrame:
    """Records with the content key that their texts have."""
    return kv_keyed(records).select("kv_offset", F.col("kv_key").alias("content_key"), "key_text", "value_text")


def kv_sources(kvs: DataFrame, records: DataFrame) -> DataFrame:
    pairs = kvs.select(short("kv_key").alias("k"), "dataset_id", "sample_id", "triple_index", "kv_index")
    joined = pairs.join(records.select(short("content_key").alias("k"), "kv_offset"), "k")
    return joined.select("kv_offset", "dataset_id", "sample_id", "triple_index", "kv_index").distinct()


def placed_kv_sources(t: DataFrame, numbers: DataFrame) -> DataFrame:
    """kv_sources of laid triples by the places of their pairs; what may be the same source meets before a triple is unfolded."""
    known = t.select("pos", "dataset_id", "sample_id", "triple_index").join(_offsets(numbers), "pos").drop("pos")
    met = _of_pairs(known.repartition("dataset_id", "sample_id", "triple_index"))
    return met.select("kv_offset", "dataset_id", "sample_id", "triple_index", "kv_index").distinct()


def _ends(t: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Both ends of keyed triples: order, role (0 for the subject), name and canonical_key."""
    end = lambda role, name, key: F.struct(F.lit(role).alias("role"), F.col(name).alias("name"), F.col(key).alias("canonical_key"))
    return t.select(*order, F.explode(F.array(end(0, "subject", "s_key"), end(1, "object", "o_key"))).alias("end")).select(*order, "end.*")


def _placed_ends(t: DataFrame) -> DataFrame:
    return _ends(with_keys(t), ("pos",)).select((F.col("pos") * 2 + F.col("role")).alias("place"), "role", "name", "canonical_key")


def forms(t: DataFrame) -> DataFrame:
    """canonical_key, name, first (place) and least (role) of every surface form of laid triples' ends."""
    return _placed_ends(t).groupBy("canonical_key", "name").agg(F.min("place").alias("first"), F.min("role").alias("least"))


def nodes(form_table: DataFrame) -> DataFrame:
    """node_id (from 1, subject before object), canonical_key, canonical_name (the first) and kind of the keys of forms: entity if it is ever a subject."""
    firsts = form_table.groupBy("canonical_key").agg(F.min_by("name", "first").alias("canonical_name"), F.min("first").alias("place"), F.min("least").alias("least"))
    kind = F.when(F.col("least") == 0, "entity").otherwise("literal").alias("kind")
    return _ranked(firsts, "node_id", 1).select("node_id", "canonical_key", "canonical_name", kind)


def aliases(form_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """alias_key, alias_name (the first) and node_id: every surface form of every node."""
    joined = form_table.withColumn("alias_key", casefold("name")).join(node_table.select("node_id", "canonical_key"), "canonical_key")
    return joined.groupBy("alias_key", "node_id").agg(F.min_by("name", "first").alias("alias_name"))


def graph_triples(t: DataFrame, node_table: DataFrame, slices: int = 1) -> DataFrame:
    """place (of the first), triple_id (from 1), triple_type, subject_id, predicate (first text), object_id, object_kind, s_key and o_key of the distinct triples.

    Triples of a kind have one subject: where its key brings them together, they meet
    its node and each other. The rest of their way carries texts and numbers only.
    Exchanges of a large build are larger than all tables: they are made in ``slices``,
    by subject and then by place, and what lies between the two is removed again.
    """
    flat = with_keys(t).select("pos", "triple_type", "s_key", "predicate", "o_key")
    s = node_table.select(F.col("canonical_key").alias("s_key"), F.col("node_id").alias("subject_id"))
    o = node_table.select(F.col("canonical_key").alias("o_key"), F.col("node_id").alias("object_id"), F.col("kind").alias("o_kind"))
    kind = F.when(F.col("triple_type") == "RELATION", F.col("o_kind")).otherwise("literal")

    def met(k: int) -> DataFrame:
        dealt = _slice(flat, "s_key", k, slices).repartition("s_key").withColumn("_p", casefold("predicate"))
        distinct = dealt.groupBy("s_key", "triple_type", "_p", "o_key").agg(F.min_by("predicate", "pos").alias("predicate"), F.min("pos").alias("place")).drop("_p")
        joined = distinct.join(_slice(s, "s_key", k, slices), "s_key").join(o, "o_key")
        return joined.select("place", "triple_type", "subject_id", "predicate", "object_id", kind.alias("object_kind"), "s_key", "o_key")

    if slices == 1:
        return _ranked(met(0), "triple_id", 1)
    between = saved_in_slices(met, slices, "met")
    ranked = _ranked(between, "triple_id", 1, slices)
    discard(between)
    return ranked


def triple_ids(t: DataFrame, placed: DataFrame) -> DataFrame:
    """pos and triple_id of all laid triples; ``placed`` has the distinct ones by the place of their first, so only copies have to look for theirs."""
    own = placed.select(F.col("place").alias("pos"), "triple_id")
    if t.count() == placed.count():
        return saved(own, "triple_ids")
    kind = ["triple_type", "s_key", "_p", "o_key"]
    at = saved(t.select("pos").join(own.select("pos"), "pos", "left_anti"), "copies")
    copies = with_keys(maybe_among(t, at, "pos").join(at, "pos")).withColumn("_p", casefold("predicate")).select("pos", *kind)
    # of the distinct triples only those move that may have a copy's subject
    firsts = maybe_among(placed, copies, "s_key").withColumn("_p", casefold("predicate")).select("triple_id", *kind)
    met = copies.join(firsts, kind)
    ids = saved(own.union(met.select("pos", "triple_id")), "triple_ids")
    discard(at)
    return ids


def triple_kvs(ids: DataFrame, numbers: DataFrame) -> DataFrame:
    """triple_id, kv_offset and ordinal (the first) of the pairs of each triple; copies of a triple meet before its pairs are unfolded."""
    known = ids.join(_offsets(numbers), "pos").drop("pos").repartition("triple_id")
    return _of_pairs(known).groupBy("triple_id", "kv_offset").agg(F.min("kv_index").alias("ordinal"))


def placed_triple_sources(t: DataFrame, ids: DataFrame) -> DataFrame:
    """triple_sources of laid triples by their places."""
    known = t.select("pos", "dataset_id", "sample_id", "triple_index", "source_index", "title").join(ids, "pos")
    return known.groupBy("triple_id", "dataset_id", "sample_id", "triple_index").agg(F.min("source_index").alias("source_index"), F.min_by("title", "source_index").alias("title"))


def triple_sources(t: DataFrame, triple_table: DataFrame) -> DataFrame:
    """Where each triple came from: triple_id, dataset_id, sample_id, triple_index, source_index and title."""
    places = t.select(short("content_key").alias("t"), "dataset_id", "sample_id", "triple_index", "source_index", "title")
    known = places.join(triple_table.select(short("content_key").alias("t"), "triple_id"), "t")
    return known.groupBy("triple_id", "dataset_id", "sample_id", "triple_index").agg(F.min("source_index").alias("source_index"), F.min_by("title", "source_index").alias("title"))


class Store:
    """The tables of one build, each computed and written once, when first asked for."""

    TABLES = ("kv_records", "nodes", "aliases", "triples", "triple_kvs", "triple_sources")
    version = 0

    def __init__(self, raw: DataFrame):
        self.parsed = parsed(raw)
        self.kvs = default_kvs(self.parsed)

    @cached_property
    def laid(self) -> DataFrame:
        return laid(self.parsed)

    @cached_property
    def keyed(self) -> DataFrame:
        return keyed(self.laid)

    @cached_property
    def kv_keyed(self) -> DataFrame:
        return kv_keyed(default_kvs(self.keyed))

    @cached_property
    def pair_numbers(self) -> DataFrame:
        return pair_numbers(self.laid)

    @cached_property
    def kv_records(self) -> DataFrame:
        return with_content_key(saved(kv_records(self.laid, self.pair_numbers), "kv_records"))

    @cached_property
    def kv_sources(self) -> DataFrame:
        return placed_kv_sources(self.laid, self.pair_numbers)

    @cached_property
    def forms(self) -> DataFrame:
        return saved(forms(self.laid), "forms")

    @cached_property
    def nodes(self) -> DataFrame:
        ranked = nodes(self.forms)
        # written whole, so that no reader joins the sums of stretches again
        table = saved(ranked, "nodes")
        discard(ranked)
        return table

    @cached_property
    def placed_triples(self) -> DataFrame:
        return graph_triples(self.laid, self.nodes, SLICES if self.laid.count() >= SLICED_FROM else 1)

    @cached_property
    def triple_ids(self) -> DataFrame:
        return triple_ids(self.laid, self.placed_triples)

    @cached_property
    def triples(self) -> DataFrame:
        return self.placed_triples.select("triple_id", _content_key().alias("content_key"), "triple_type", "subject_id", "predicate", "object_id", "object_kind")

    @cached_property
    def triple_kvs(self) -> DataFrame:
        return saved(triple_kvs(self.triple_ids, self.pair_numbers), "triple_kvs")

    @cached_property
    def titles(self) -> DataFrame:
        """triple_id and the first title that isn't empty."""
        named = self.laid.where("title != ''").select("pos", "title").join(self.triple_ids, "pos")
        return saved(named.groupBy("triple_id").agg(F.min_by("title", "pos").alias("title")), "titles")

    @cached_property
    def triple_sources(self) -> DataFrame:
        return saved(placed_triple_sources(self.laid, self.triple_ids), "triple_sources")

    @cached_property
    def aliases(self) -> DataFrame:
        return saved(aliases(self.forms, self.nodes), "aliases")

    @cached_property
    def incidence(self) -> DataFrame:
        """All incident triples with their rank; laid out by node, so that expansions read it without sorting it again."""
        slices = SLICES if self.triples.count() >= SLICED_FROM else 1
        return saved_in_slices(lambda k: incidence(self.triples, part=lambda df: _slice(df, "node_id", k, slices)).repartition("node_id").sortWithinPartitions("node_id"), slices, "incidence")

    def write(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


class StoredTables(Store):
    """A store that ``Store.write`` left at a path."""

    def __init__(self, spark: SparkSession, path: str):
        for name in self.TABLES:
            self.__dict__[name] = spark.read.parquet(f"{path}/{name}")

    @cached_property
    def titles(self) -> DataFrame:
        return first_titles(self.triple_sources)


def first_titles(sources: DataFrame) -> DataFrame:
    """triple_id and the first title of its sources that isn't empty."""
    return sources.where("title != ''").groupBy("triple_id").agg(F.min_by("title", F.struct("dataset_id", "source_index", "triple_index")).alias("title"))


def hydrated(store: Store) -> DataFrame:
    """Triples with the names of both ends and the first title that isn't empty."""
    name = lambda side: store.nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("canonical_name").alias(f"{side}_name"))
    titles = store.titles
    joined = store.triples.drop("content_key").join(name("subject"), "subject_id").join(name("object"), "object_id").join(titles, "triple_id", "left")
    return joined.select("triple_id", "triple_type", "subject_name", "predicate", "object_name", "object_kind", F.coalesce("title", F.lit("")).alias("title"))


def incidence(triple_table: DataFrame, cap: int | None = None, part: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """node_id, triple_id, other_id and rank: forward triples first, then backward ones, each by id; ``cap`` keeps the first, ``part`` some nodes."""
    forward = triple_table.select(F.col("subject_id").alias("node_id"), "triple_id", F.col("object_id").alias("other_id"), F.lit(0).alias("direction"))
    backward = triple_table.where("object_kind = 'entity' and subject_id != object_id").select(F.col("object_id").alias("node_id"), "triple_id", F.col("subject_id").alias("other_id"), F.lit(1).alias("direction"))
    ranked = part(forward.union(backward)).withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy("direction", "triple_id")))
    return ranked.where(F.col("rank") <= cap) if cap else ranked


def resolve(names: DataFrame, store: Store, column: str = "name") -> DataFrame:
    """node_id of names: by canonical key, else by alias with the lowest node_id; null if unknown."""
    by_alias = store.aliases.groupBy("alias_key").agg(F.min("node_id").alias("alias_node"))
    keyed = names.withColumn("canonical_key", canonical_entity_key(column)).withColumn("alias_key", casefold(normalize_text(column)))
    joined = keyed.join(store.nodes.select("canonical_key", "node_id"), "canonical_key", "left").join(by_alias, "alias_key", "left")
    return joined.select(*names.columns, F.coalesce("node_id", "alias_node").alias("node_id"))


def fetch_in_order(requests: DataFrame, records: DataFrame, key: str = "kv_offset") -> DataFrame:
    """Records for an array of keys, in the order asked for, repeats included: columns of requests, pos and the record."""
    asked = requests.select("*", F.posexplode("keys").alias("pos", key)).drop("keys")
    return asked.join(records, key, "left")
