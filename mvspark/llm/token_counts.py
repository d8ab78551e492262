"""Token counts by section: encode a document once, attribute its tokens by their offsets.

A document is encoded whole, so that no token depends on how it is cut. Sections (here: lines,
or any spans of characters) are intervals of its bytes, as are tokens; a sorted interval join
attributes every token to the sections it touches. The rule for a token across a boundary: it
goes whole to the section that holds most of its bytes, of equal ones to the first; a token
outside all sections (a line break on its own) goes to the section that ends last before it, or
to the first one. So the counts of a document's sections always add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mvspark.llm.common import text_batches
from mvspark.llm.token_store import BATCH, encoder, tokenizer_path


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line of a text, its line break not included; an empty text is one empty line."""
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])


def attribute(ends: np.ndarray, starts: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Section of each token. Tokens: starts, ends; sections: start, end; all ascending and without overlap."""
    first = np.searchsorted(end, starts, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(start, ends, side="left") - 1  # the last one that starts before its end
    near = np.clip(first, 0, len(start) - 1)
    outside = np.minimum(end[near], ends) <= np.maximum(start[near], starts)
    out = np.clip(np.where(outside, first - 1, near), 0, len(start) - 1)
    for t in np.flatnonzero(last > first).tolist():
        sections = np.arange(first[t], last[t] + 1)
        held = np.minimum(end[sections], ends[t]) - np.maximum(start[sections], starts[t])
        if held.max() > 0:
            out[t] = sections[int(np.argmax(held))]
    return out


def count_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, spans=line_spans) -> DataFrame:
    """Rows (id_col, section, start, end, n_tokens): each section's place in bytes of the text and its tokens.

    A null text counts as empty: one section without tokens. Repeated rows and null ids give their
    own rows; an empty table gives none.
    """
    path = tokenizer or tokenizer_path()
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        sizes = bpe.sizes
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                ids, texts = batch.column(0).slice(a, BATCH), batch.column(1).slice(a, BATCH).to_pylist()
                row, section, starts, ends, counts = [], [], [], [], []
                for k, (text, found) in enumerate(zip(texts, bpe.encode(texts))):
                    start, end = spans(text.encode())
                    stop = np.cumsum(sizes[found])
                    of = attribute(stop, stop - sizes[found], start, end)
                    row.append(np.full(len(start), k))
                    section.append(np.arange(len(start)))
                    starts.append(start)
                    ends.append(end)
                    counts.append(np.bincount(of, minlength=len(start)))
                cols = [ids.take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (section, starts, ends, counts))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "section", "start", "end", "n_tokens"])

    out = rows.mapInArrow(run, f"id {kind}, section long, start long, end long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
