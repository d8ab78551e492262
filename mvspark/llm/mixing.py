"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as
they are) and normalised. The exponent is bisected to the largest one at which the weights'
entropy reaches a target, or, without a target, to the smallest one at which no source is
repeated more often than a limit.

The weights are realised under a token budget: each source is cut in BLOCKS blocks by a hash of
the id, and its share of the budget is filled with whole passes over its blocks and then, in a
permutation of the blocks, with further blocks while they fit; the block that no longer fits
gives its documents in hash order while they fit. Every document so gets a number of copies.

Permutations are orders of hash values, so the part of a source that gets one more copy is told
by two bounds: the hash of the block in which the budget ends and the hash of the last document
that fits in it. Only sums by block and that one block are put in order; no source, however
large, is one group, and texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mvspark.llm.common import stored

BLOCKS, STEPS = 1024, 50
#: Up to so many sources the bounds, a row each, are broadcast.
BROADCAST_SOURCES = 10_000
SPACE = r"[ \t\n\r\f\x0B]+"


def token_count(text: Column) -> Column:
    """Tokens of a text for the shares: runs of characters other than white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def weights(tokens: dict[str, float], alpha: float) -> dict[str, float]:
    total = sum(tokens.values())
    raised = {k: (n / total) ** alpha for k, n in sorted(tokens.items())}
    norm = sum(raised.values())
    return {k: v / norm for k, v in raised.items()}


def solve(tokens: dict[str, float], budget: float, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent. entropy: target as a share of the greatest possible one; repeats: most passes over any source."""
    tokens = {k: n for k, n in tokens.items() if n > 0}
    if len(tokens) < 2:
        return 1.0

    def flat(alpha: float) -> bool:
        w = weights(tokens, alpha)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values() if x > 0) >= entropy * math.log(len(w))
        return max(w[k] * budget / n for k, n in tokens.items()) > repeats

    if entropy is None and repeats is None:
        return 1.0
    low, high = 0.0, 1.0
    if flat(1.0):
        return 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if flat(mid) else (low, mid)
    return low if entropy is not None else high


def mix(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repeats: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """Rows (id_col, source_col, n_tokens, copies), one for each row of docs, in no order.

    The budget is budget_share of all tokens. A null source is a source of its own. Rows without
    tokens are free. Rows that repeat an id are taken together or not at all; a null id is an id like
    any other. A source without tokens is passed once; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n"))
    return assign(rows, budget_share, entropy, repeats, blocks).select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("n").alias("n_tokens"), "copies")


def sample(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repeats: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it has copies (see mix)."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n"))
    out = assign(rows, budget_share, entropy, repeats, blocks).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def order_key(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def assign(rows: DataFrame, budget_share: float, entropy: float | None, repeats: float | None, blocks: int = BLOCKS) -> DataFrame:
    """rows with columns id, source, n and others, and copies added."""
    own = rows.columns
    rows = rows.withColumn("_source", F.coalesce(F.col("source"), F.lit("\0"))).withColumn("_key", order_key("doc", F.col("id")))
    rows = rows.withColumn("_block", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(blocks)))
    rows = rows.withColumn("_order", order_key("block", F.col("_source"), F.col("_block")))
    narrow = rows.select("_source", "_order", "_key", "n")
    sums = stored(narrow.groupBy("_source", "_order").agg(F.sum("n").alias("sum")), "blocks")
    totals = {r["_source"]: r["t"] for r in sums.groupBy("_source").agg(F.sum("sum").alias("t")).collect()}  # one row a source
    budget = budget_share * sum(totals.values())
    alpha = solve(totals, budget, entropy, repeats)
    positive = {k: n for k, n in totals.items() if n > 0}
    target = {k: int(w * budget) for k, w in (weights(positive, alpha) if positive else {}).items()}
    plan = [(k, target.get(k, 0) // n if n else 1, target.get(k, 0) % n if n else 0) for k, n in sorted(totals.items())]
    plan = rows.sparkSession.createDataFrame(plan, "_source string, passes long, rest long")

    w = Window.partitionBy("_source").orderBy("_order")  # BLOCKS rows a source at most
    left = F.col("rest") - F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks_left = sums.join(plan, "_source").withColumn("left", left).where(F.col("sum") > F.col("left"))
    edge = blocks_left.groupBy("_source").agg(F.min("_order").alias("_edge"), F.min_by("left", "_order").alias("left"))
    inside = Window.partitionBy("_source").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    last = narrow.join(F.broadcast(edge) if len(totals) <= BROADCAST_SOURCES else edge, "_source").where("_order = _edge")
    last = last.withColumn("_used", F.sum("n").over(inside)).where("_used <= left").groupBy("_source").agg(F.max("_key").alias("_cut"))
    bounds = plan.select("_source", "passes").join(edge.drop("left"), "_source", "left").join(last, "_source", "left")
    out = rows.join(F.broadcast(bounds) if len(totals) <= BROADCAST_SOURCES else bounds, "_source")
    more = (F.col("_order") < F.col("_edge")) | ((F.col("_order") == F.col("_edge")) & (F.col("_key") <= F.col("_cut")))
    return out.select(*own, (F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")).alias("copies"))
