"""Language identification by compression.

Texts are folded first: lower case, everything but letters becomes one space. Each language has a
zstandard raw-content dictionary of its folded training text. A text is cut in pieces of PIECE bytes and every piece is compressed on its own with every dictionary, so that
the dictionary, not the text's own beginning, is what helps; the language with the fewest bytes
in all wins. The whole text counts. The margin to the second smallest is the confidence, and
narrow margins are marked as rejected.

The dictionaries are made from a bounded sample of labelled rows: at most DOCS texts a language, in
the order of a hash of id and text. Their whole texts are cut in pieces of PIECE bytes; a dictionary
takes first one piece of each text, then a second one, and so on, each drawn by hash from the whole
text, up to DICT_BYTES bytes. That is all that is sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mvspark.llm.common import held_out, stored, text_batches, train_row

DOCS, DICT_BYTES, PIECE, LEVEL = 800, 256 * 1024, 1024, 6
#: Texts whose best and second size differ by less than this share are rejected.
MARGIN = 0.01
UNKNOWN = "und"
_REST = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    return _REST.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def pieces(text: str) -> list[tuple[float, bytes]]:
    """Pieces of a whole folded text in the order of a hash, with their turn: 0 and a fraction for the first, 1 and ... for the second."""
    data = folded(text).strip(b" ")
    cut = sorted((xxhash.xxh64_intdigest(p, k), p) for k, p in enumerate(data[i : i + PIECE] for i in range(0, len(data), PIECE)))
    return [(turn + h / 2**64, p) for turn, (h, p) in enumerate(cut)]


def _best(found: dict[str, list[tuple[float, bytes]]]) -> dict[str, list[tuple[float, bytes]]]:
    """Of each language the pieces whose turn comes first, up to DICT_BYTES."""
    out = {}
    for lang, some in found.items():
        some.sort()
        size = np.cumsum([len(p) + 1 for _, p in some])
        out[lang] = some[: int(np.searchsorted(size, DICT_BYTES)) + 1]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language from at most DOCS training texts each (see common.train_row).

    Rows without a language, a text or an id don't count; rows that repeat id, text and language count
    once; texts without a letter give nothing. Without any row there are no dictionaries.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(train_row(F.col("id")) & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    u = F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(1 << 30)) / (1 << 30)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    # of few more keys than DOCS a language, which a hash below that share leaves, the first DOCS
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, DOCS / n)))))
    keys = rows.select("lang", "h", u.alias("u")).where(F.col("u") <= F.element_at(share, F.col("lang"))).distinct()
    w = Window.partitionBy("lang").orderBy("u", "h")
    keys = stored(keys.withColumn("r", F.row_number().over(w)).where(F.col("r") <= DOCS).select("lang", "h"), "sampled")
    picked = rows.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[tuple[float, bytes]]] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                found.setdefault(lang, []).extend(pieces(text))
            found = _best(found)  # what a task holds and returns is DICT_BYTES a language
        out = [(lang, turn, p) for lang, some in found.items() for turn, p in some]
        yield pd.DataFrame(out, columns=["lang", "turn", "piece"])

    found: dict[str, list[tuple[float, bytes]]] = {}
    for r in picked.mapInPandas(cut, "lang string, turn double, piece binary").toLocalIterator():
        found.setdefault(r["lang"], []).append((r["turn"], bytes(r["piece"])))
    out = {}
    for lang, some in sorted(_best(found).items()):
        data = b"\n".join(p for _, p in reversed(some))[-DICT_BYTES:]  # zstandard prefers what stands last
        out[lang] = data if len(data) >= 8 else data + b" " * 8
    return out


def classifier(dictionaries: dict[str, bytes], level: int = LEVEL):
    """A function from a text to (language, score, margin)."""
    names = sorted(dictionaries)
    coders = []
    for name in names:
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(text: str | None) -> tuple[str, float, float]:
        if not text or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        data = folded(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
        order = sorted(range(len(names)), key=lambda k: (sizes[k], names[k]))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        # shares of evidence: a language that needs one per cent more of all bytes gets e^-1 of the weight
        weights = [math.exp(-100 * (s - best) / best) for s in sizes]
        return names[order[0]], 1 / sum(weights), margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score (0 to 1), margin, rejected.

    Null texts, texts without a letter and an empty set of dictionaries give "und" with score 0,
    rejected. Repeated rows and null ids (never held out) stay; only id and text are read.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICT_BYTES a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = classifier(shared.value)
        for pdf in batches:
            found = [classify(t if isinstance(t, str) else None) for t in pdf["text"]]
            lang, score, margin = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": list(lang), "score": np.array(score, dtype=float), "margin": np.array(margin, dtype=float)})

    out = rows.mapInPandas(run, f"id {kind}, lang_pred string, score double, margin double")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < MARGIN)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "margin", rejected.alias("rejected"))
