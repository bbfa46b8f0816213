"""Token counts of a SentencePiece model without materialising the ids of texts.

Each task keeps a bounded table from pre-token to its number of pieces. For a
slice of documents it takes the pre-token frequencies of each document, counts
the pieces of pre-tokens not yet in the table once, and joins frequencies to
counts: a map-side join, so no (document, pre-token) rows are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lattica.llm.columns import needed
from lattica.llm.pieces import read_model
from lattica.llm.textscan import as_batches, map_arrow, slices

MARK = "▁"
#: A task forgets its counted pre-tokens when it holds so many.
TABLE_ROWS = 600_000
_runs = re.compile(f"{MARK}+[^{MARK}]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text without their first mark: cuts that no piece reaches across."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [run[1:] for run in _runs.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Counts equal the library's own encoding without begin and end tokens. A null
    text counts as empty, with no tokens; repeated rows are counted each.
    """
    model_bytes = read_model(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        pieces: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                frequencies = [Counter(pre_tokens(t or "")) for t in texts]
                if len(pieces) > TABLE_ROWS:
                    pieces.clear()
                new = list(set().union(*frequencies) - pieces.keys())
                pieces.update(zip(new, map(len, library.encode(new, num_threads=1)), strict=True))
                pieces[""] = 1
                totals = [sum(pieces[t] * n for t, n in f.items()) for f in frequencies]
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0)
                yield from as_batches([{"doc_id": part.column("doc_id"), "n_bytes": sizes, "n_tokens": totals, "over_limit": [n > limit for n in totals]}], schema)

    return map_arrow(needed(docs, doc_id="long", text="string"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
