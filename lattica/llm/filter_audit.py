"""Audit of how filters interact: what each removes, in every order of applying them.

One pass over the documents, sorted over range partitions by fingerprint of the
text, the text and doc_id, sets a bit for each filter a document fails. Equal
texts then stand side by side, however many there are and in however many
partitions: a document compares itself with the one before it, and the first text
of a partition with the last one of the partition before. Masks are merged into
counters by part, from which all orders follow.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.columns import needed
from lattica.llm.textscan import as_batches, map_arrow, slices
from lattica.session import saved

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
#: The characters that fail a document by D.
SYMBOLS = b"#$%&*|"
_capitals = bytes(range(65, 91))
_symbols = re.compile(b"[" + re.escape(SYMBOLS) + b"]")


def mask_of(text: str) -> int:
    """Bits 0 to 3: the text fails A (under 100 words), B (under 80 % distinct words), C (over 10 % capitals), D (a symbol)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at [\x20\x09-\x0D], unlike str
    capitals = len(data) - len(data.translate(None, _capitals))
    few, alike = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words)
    return few | alike << 1 | (100 * capitals > MAX_CAPITALS * len(text)) << 2 | (_symbols.search(data) is not None) << 3


def failures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, mask; bits 0 to 4 of mask say which of A to E the row fails.

    E: another row has the same text and a smaller doc_id. A null text is empty; an
    empty text fails A alone, and E if an earlier one is empty too. A null doc_id is
    smaller than none and greater than none. Rows of one doc_id don't fail E by each
    other. Long texts are read whole, one at a time.

    The bounds of the range partitions are drawn over the SHA-256 of the text and
    doc_id, since bounds over texts would send texts to the driver; rows are sorted
    by SHA-256, text and doc_id, and compared by text within a partition. Over a
    border, where no two texts meet in a task, the SHA-256 and the length decide.
    """
    keyed = needed(docs, doc_id="long", text="string", lang="string").withColumn("text", F.coalesce("text", F.lit("")))
    keyed = keyed.withColumn("print", F.unhex(F.sha2("text", 256)))
    laid = keyed.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("lang", pa.string()), ("mask", pa.int8()), ("head", pa.bool_()), ("tail", pa.bool_()), ("print", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        head, last, failed, last_id, last_print = True, None, False, None, None
        row: dict[str, list] = {}

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            n = len(row.get("doc_id", ()))
            if n:
                at_end = [False] * n
                if final:
                    at_end[-1], row["print"][-1], row["size"][-1] = True, last_print, len(last)
                yield from as_batches([row | {"part": [part] * n, "tail": at_end}], schema)

        for batch in batches:
            for cutting in slices(batch, "text"):
                yield from flush(False)
                row = {name: [] for name in ("doc_id", "lang", "mask", "head", "print", "size")}
                for doc_id, text, lang, digest in zip(*(cutting.column(c).to_pylist() for c in ("doc_id", "text", "lang", "print")), strict=True):
                    if text == last:
                        failed = failed or (last_id is not None and last_id < doc_id)
                    else:
                        head, failed, mask = last is None, False, mask_of(text)
                    last, last_id, last_print = text, doc_id, digest
                    for name, value in (("doc_id", doc_id), ("lang", lang), ("mask", mask | failed << 4), ("head", head), ("print", digest if head else None), ("size", len(text) if head else None)):
                        row[name].append(value)
        yield from flush(True)

    ddl = "part int, doc_id long, lang string, mask byte, head boolean, tail boolean, print binary, size long"
    rows = saved(map_arrow(laid.select("doc_id", "text", "lang", "print"), run, ddl), "failures")
    # one row for each partition: its first text, and the last one of the partition before
    heads = rows.where("head").groupBy("part").agg(F.first("print").alias("print"), F.first("size").alias("size"))
    tails = rows.where("tail").select("part", F.col("print").alias("last"), F.col("size").alias("last_size"), F.col("doc_id").isNotNull().alias("has_id"))
    in_turn = Window.orderBy("part")
    joined = heads.join(tails, "part").select("part", "print", "size", *[F.lag(c).over(in_turn).alias(c) for c in ("last", "last_size", "has_id")])
    carried = joined.select("part", F.coalesce((F.col("print") == F.col("last")) & (F.col("size") == F.col("last_size")) & F.col("has_id"), F.lit(False)).alias("carried"))
    again = F.when(F.col("head") & F.col("carried") & F.col("doc_id").isNotNull(), F.lit(1 << 4)).otherwise(0)
    return rows.join(F.broadcast(carried), "part").select("doc_id", "lang", F.col("mask").cast("int").bitwiseOR(again).alias("mask"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) for every order of the filters."""
    found = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            found.append(("".join(order), step, bit, before))
            before |= bit
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at each step of each order, by part (the document's lang, null: empty).

    Columns: part, filter_order, step and, counted in documents of the part, kept,
    removed, redundant, unique_fails, good_lost (labels.quality 1), toxic_lost
    (labels.toxic 1) and shapley (what the step's filter removes, summed over all
    orders). A document labelled more than once is good or toxic if one row says
    so; rows of a doc_id that stands more than once count each. Zeros are included;
    no documents give no rows.
    """
    masks = failures(docs).groupBy("doc_id", "lang", "mask").agg(F.count("*").alias("n"))
    known = needed(labels, doc_id="long", quality="int", toxic="int").where(F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")])
    held = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    counters = masks.join(known, "doc_id", "left").groupBy(F.coalesce("lang", F.lit("")).alias("part"), "mask").agg(F.sum("n").alias("n"), held("quality").alias("good"), held("toxic").alias("bad"))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("prior")) for o, s, b, p in orders()])
    each = counters.select("part", "mask", "n", "good", "bad", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "bad", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("prior")) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    by_step: list[Column] = [count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails")]
    by_step += [count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "bad").alias("toxic_lost")]
    found = each.groupBy("part", "filter_order", "step", "bit").agg(*by_step)
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
