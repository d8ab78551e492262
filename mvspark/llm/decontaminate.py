"""Benchmark decontamination by winnowing.

Words: A-Z lower-cased, runs of digits, a-z and non-ASCII characters. Of the hashes of all K-word
grams the smallest in every WINDOW consecutive ones is kept (of equal ones the first), once for all
the windows that it is the smallest of: about two of seven grams. Documents and benchmark items are
treated alike, so a shared span of K + WINDOW - 1 = SPAN words shares a kept hash, whatever stands
around it. Kept grams are joined; where a document's gram is one that the benchmark keeps too, the
hit is extended: the windows of SPAN words around the gram are compared with the items' windows
word by word. An item of fewer than SPAN words is one window of its own length; for the few
lengths that occur, all grams of that length are compared. DataFrame operations only.

Long texts are cut in chunks of CHUNK words that overlap by SPAN - 1, so that no row grows with
its text and no window is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mvspark.llm.common import ascii_lower, checked_broadcast, keyed, row_key, stored

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
CHUNK = 4096
#: What stands between words, in lower-cased texts and in texts that still have A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of the benchmark are broadcast up to so many bytes of text and row overhead; beyond it the joins are shuffled.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _kept(chunks: DataFrame) -> DataFrame:
    """Rows (..., w, p, f): place (from 0) and hash of each gram in the words w that is the first smallest of a window of WINDOW.

    Words are hashed once; grams and minima are plain expressions over array elements, which Spark compiles.
    A window hands on a new gram if its smallest hash is another one than that of the window before,
    or if that one's gram has just left.
    """
    own = chunks.columns
    rows = chunks.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - SPAN)).alias("j"))
    # step by step, so that each gram is hashed once: g0 has left, the others are the window
    rows = rows.select(*own, "j", *(F.xxhash64(*(F.get("wh", F.col("j") + (a + b)) for b in range(K))).alias(f"g{a + 1}") for a in range(-1, WINDOW)))
    names = [f"g{a}" for a in range(WINDOW + 1)]
    rows = rows.select("*", F.least(*names[1:]).alias("least"), F.least(*names[:-1]).alias("before"))
    place = F.lit(WINDOW - 1)
    for a in range(WINDOW - 2, -1, -1):
        place = F.when(F.col(names[a + 1]) == F.col("least"), a).otherwise(place)
    new = (F.col("j") == 0) | (F.col("least") != F.col("before")) | (F.col("g0") == F.col("before"))
    # as an array, as the conditions would be moved below the steps as a filter
    return rows.select(*own, F.inline(F.when(new, F.array(F.struct((F.col("j") + place).alias("p"), F.col("least").alias("f"))))))


def _span_at(w: Column, start: Column, n) -> Column:
    # never null, which spares the optimizer from testing that before the look-up
    return F.coalesce(F.array_join(F.slice(w, start, n), " "), F.lit(""))


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows (..., w) as rows (..., c, w) of at most CHUNK + SPAN - 1 words."""
    n = F.greatest(F.ceil((F.size("w") - (SPAN - 1)) / CHUNK), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct(c.alias("c"), F.slice("w", c * CHUNK + 1, CHUNK + SPAN - 1).alias("w")))
    others = [c for c in rows.columns if c != "w"]
    return rows.select(*others, F.explode(parts).alias("p")).select(*others, "p.c", "p.w")


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (n, span, item): the windows of the benchmark, each once an item that holds it."""
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(SPAN))
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: _span_at(F.col("w"), i, n))
    return w.select("item", n.alias("n"), F.explode(spans).alias("span")).distinct().select("n", "span", "item")


def hits(docs: DataFrame, items: DataFrame, windows: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (_i, _th, n, start, span): where documents hold a window (see item_windows), each place once; see common.row_key for the first two.

    Null texts and texts without words hold none; rows that repeat an id and its text count once.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(*row_key(F.col(id_col), F.col(text_col)), words(F.col(text_col)).alias("w"))
    windows = windows.select("n", "span").distinct()
    sizes = {r["n"]: r["b"] for r in windows.groupBy("n").agg(F.sum(F.octet_length("span") + 64).alias("b")).collect()}  # at most SPAN rows
    bounded = sum(sizes.values()) <= broadcast_bytes
    small = F.broadcast if bounded else (lambda df: df)

    found = []
    if SPAN in sizes:
        item_words = items.where(F.col(item_col).isNotNull()).select(words(F.col(item_text)).alias("w"))
        known = _kept(_chunks(item_words).where(F.size("w") >= SPAN)).select("f").distinct()
        chunks = _chunks(texts).where(F.size("w") >= SPAN)
        kept = _kept(chunks)
        if bounded:
            near = kept.join(F.broadcast(known), "f", "left_semi")
        else:  # the words stay behind: only keys and places are shuffled for the look-up
            at = kept.drop("w").join(known, "f", "left_semi").groupBy("_i", "_th", "c").agg(F.collect_set("p").alias("ps"))
            near = chunks.join(at, ["_i", "_th", "c"]).select("_i", "_th", "c", "w", F.explode("ps").alias("p"))
        first, last = F.greatest(F.col("p") - (SPAN - K), F.lit(0)), F.least(F.col("p"), F.size("w") - SPAN)
        near = near.select("_i", "_th", "c", "w", F.explode(F.sequence(first, last)).alias("s"))
        found.append(near.select("_i", "_th", F.lit(SPAN).alias("n"), (F.col("s") + 1 + F.col("c") * CHUNK).alias("start"), _span_at(F.col("w"), F.col("s") + 1, SPAN).alias("span")))
    for n in sorted(k for k in sizes if k < SPAN):
        spans = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: _span_at(F.col("w"), s, n))
        rows = _chunks(texts).where(F.size("w") >= n).select("_i", "_th", "c", F.posexplode(spans).alias("p", "span"))
        found.append(rows.select("_i", "_th", F.lit(n).alias("n"), (F.col("p") + 1 + F.col("c") * CHUNK).alias("start"), "span"))
    if not found:
        return texts.select("_i", "_th", F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit("").alias("span")).where("false")

    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows.join(small(windows), ["n", "span"], "left_semi").select("_i", "_th", "n", "start", "span").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit (words inside any occurrence of a window), items (array of ids).

    A null or wordless text has no words and no hits. An item with a null id or without words is no
    item; rows that repeat an item's id add windows to it. Documents are told apart by id and text,
    so repeated rows and null ids get the result of their text. Other columns are ignored.
    """
    windows = stored(item_windows(items, item_col, item_text), "windows")
    found = stored(hits(docs, items, windows, id_col, text_col, item_col, item_text, broadcast_bytes), "hits")
    w = Window.partitionBy("_i", "_th").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(w), F.col("start"))), F.lit(0))
    covered = found.select("_i", "_th", new.alias("new")).groupBy("_i", "_th").agg(F.sum("new").cast("long").alias("n_hit"))
    pairs = found.select("_i", "_th", "n", "span").distinct().join(windows, ["n", "span"]).select("_i", "_th", "item").distinct()
    pairs = pairs.groupBy("_i", "_th").agg(F.collect_list("item").alias("items"))  # what a row of the result holds
    n_words = F.coalesce(F.size(F.array_remove(F.split(F.col(text_col), ANY_BETWEEN), "")), F.lit(0)).cast("long")
    out = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), n_words.alias("n_words"))
    out = out.join(covered.join(pairs, ["_i", "_th"]), ["_i", "_th"], "left")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array()).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item.

    Null and wordless texts stay, as do repeated rows and null ids without a hit; without items all
    rows stay; an empty table gives an empty one.
    """
    windows = stored(item_windows(items, item_col, item_text), "windows")
    found = stored(hits(docs, items, windows, id_col, text_col, item_col, item_text).select("_i", "_th").distinct(), "contaminated")
    return keyed(docs, id_col, text_col).join(checked_broadcast(found), ["_i", "_th"], "left_anti").select("_row.*")


def digest(found: DataFrame) -> DataFrame:
    """n_items, items_sha256 and contaminated in place of items."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(ids, 256))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("items")
