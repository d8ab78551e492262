"""Personal data: candidate spans from high-recall generators, chosen by boosted trees.

Base rules find e-mail addresses, IP addresses, payment cards and telephone numbers, leftmost
and without overlap per kind; their spans always stay. Wider generators propose further
spans, which may overlap those and one another: runs of digits with separators, telephone and card
numbers by their usual groups, and addresses with "(at)" and "dot" written out. Gradient-boosted
trees score every proposed span from its format and its context.

What the trees learn from is a labelled seed table, built by rule (see seeds): formats of telephone
numbers, cards, written-out addresses and of other numbers (dates, order numbers, amounts), each in
contexts that speak for or against it. A proposal is a positive example if it is just the span that a
positive seed holds; parts of it, and all proposals of negative seeds, are negative ones. So the base
rules' verdicts label nothing. One half of the seeds fits the trees, the other calibrates: the lowest
score at which its spans keep the wanted precision, in all above it and in those at that score, is the
threshold of a kind; a proposal of the corpus above it that overlaps no base span is added.

The trees are applied as SQL expressions. Everything is DataFrame operations: no text leaves its task.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mvspark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
#: The base rules. A guard stands before the two that begin with an open run, so that long runs
#: cost linear time: a leftmost match begins at the run's start or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "number": r"[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "grouped": r"\+?(?<![0-9])[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "area": r"\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "block": r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4,7}(?![0-9])",
    "address": rf"(?i)(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?(?:@|\(at\)|\[at\]|\bat\b) ?[A-Z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\bdot\b) ?[A-Z0-9-]++)++",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: Words before a span that speak for a person's number or address, or for another number.
PERSONAL_WORDS = r"tel|phone|telephone|telefon|call|fax|mobile|cell|text|whatsapp|ring|reach|number is|e-?mail|mail|write|contact|card|visa|mastercard|amex|credit|pay"
OTHER_WORDS = r"order|invoice|isbn|issn|version|ticket|part|serial|id|page|article|lot|doi|ref|code|sku|model|total of|between|no"
FEATURES = ("f_kind", "f_digits", "f_groups", "f_style", "f_before", "f_after", "f_word", "f_tail", "f_luhn", "f_lead")
PRECISION, LEAST, ROUNDS, RATE = 0.98, 0.9, 40, 0.6


#: Formats of the seeds; "#" is any digit. Telephone numbers that need no context, and those that do.
CLEAR_PHONES = ("###-###-####", "(###) ###-####", "1-###-###-####", "+## ## #######", "+# (###) ###-####", "+# ### ### ####", "+##.##.#######")
VAGUE_PHONES = ("### ### ####", "###.###.####", "0## #######", "0### ######", "0### ### ####", "00## ## ########", "0##-#######")
CARDS = ("#### #### #### ####", "####-####-####-####", "################", "#### ###### #####", "###############")
ADDRESSES = ("jane.doe (at) example (dot) org", "j.smith [at] mail [dot] example [dot] com", "info (at) shop.example.net", "maria at example dot org", "team @ example.com", "user_7 [at] host-1.example.org")
OTHERS = ("####-##-##", "##.##.####", "####-####", "#######", "########", "##########", "# ### ###", "### ### ###", "#.########", "###-#-##-######-#", "#### #### ####", "############", "##.##.## ####")
NO_ADDRESSES = ("look at this dot here", "met at ten dot sharp", "sat at home dot dot", "stay at inn dot so", "was at point dot three")
PERSONAL = ("call {}", "phone: {}", "tel. {}", "Fax {} please", "mobile {} or mail", "my number is {}.", "contact: {}", "reach us at {} today", "ring {} after six", "text me on {}")
PAYING = ("card {}", "my visa {} is lost", "pay with {}", "credit card: {}.")
WRITING = ("write to {}", "mail: {}", "contact {} now", "{}", "ask {} about it")
PLAIN = ("{}", "ours is {} now", "see {} and so on", "then {} came")
OTHER = ("order {}", "invoice no. {}", "isbn {}", "version {}", "ticket {} was closed", "part {} in stock", "serial {}", "id: {}", "page {}", "a total of {}", "lot {}", "ref {}")
#: Seeds a format and context.
REPEATS = 2


def _valid(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def seeds() -> list[tuple[int, str, int, int, int]]:
    """Rows (id, text, start, end, label): every format in every context that it has a label in."""
    rng, out = random.Random(1), []

    def filled(form: str, valid: bool | None) -> str:
        while True:
            text = re.sub("#", lambda _: str(rng.randrange(10)), form)
            if valid is None or _valid(re.sub("[^0-9]", "", text)) == valid:
                return text

    def add(forms: tuple, contexts: tuple, label: int, valid: bool | None = None) -> None:
        for form in forms:
            for context in contexts:
                for _ in range(REPEATS):
                    span, start = filled(form, valid), context.index("{}")
                    out.append((len(out), context.format(span), start, start + len(span), label))

    add(CLEAR_PHONES, PERSONAL + PLAIN, 1)
    add(CLEAR_PHONES[:3], OTHER, 0)
    add(VAGUE_PHONES, PERSONAL, 1)
    add(VAGUE_PHONES, PLAIN + OTHER, 0)
    add(CARDS, PAYING + PLAIN + PERSONAL, 1, True)
    add(CARDS, OTHER, 0, True)
    add(CARDS, PAYING + PLAIN + OTHER, 0, False)
    add(ADDRESSES, WRITING, 1)
    add(OTHERS, PLAIN + OTHER, 0)
    add(NO_ADDRESSES, PLAIN + ("we {}", "they {}"), 0)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits has a Luhn sum that 10 divides."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def _hits(text: Column, by: str, pattern: str, where: Column) -> Column:
    """Array of (by, i, gap, hit, before, after): the matches in order and the length of what precedes each."""
    empty = F.array().cast("array<struct<by:string,i:int,gap:int,hit:string,before:string,after:string>>")

    def rows(x: Column) -> Column:
        def row(i: Column) -> Column:
            gap = x["gaps"][i]
            return F.struct(F.lit(by).alias("by"), i.alias("i"), F.char_length(gap).alias("gap"), x["hits"][i].alias("hit"), F.substring(gap, -24, 24).alias("before"), F.substring(x["gaps"][i + 1], 1, 8).alias("after"))

        return F.when(F.size(x["hits"]) > 0, F.transform(F.sequence(F.lit(0), F.size(x["hits"]) - 1), row)).otherwise(empty)

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(where, F.transform(F.array(parts), rows)[0]).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (id, th, by, start, end, hit, before, after) for base rules and wide generators; docs has id, th, text."""
    text = F.col("text")
    at, plus, digit = F.contains(text, F.lit("@")), F.contains(text, F.lit("+")), text.rlike("[0-9]")
    spelt = at | text.rlike(r"(?i)[(\[]at[)\]]|\bat [a-z0-9-]+ dot\b")
    parts = [_hits(text, k, BASE[k], w) for k, w in (("email", at), ("ip", digit), ("card", digit), ("phone", plus))]
    parts += [_hits(text, k, WIDE[k], digit) for k in ("number", "grouped", "area", "block")] + [_hits(text, "address", WIDE["address"], spelt)]
    rows = docs.where(at | plus | digit | spelt).select("id", "th", F.inline(F.concat(*parts))).distinct()
    w = Window.partitionBy("id", "th", "by").orderBy("i")
    length = F.char_length("hit").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(w)).withColumn("start", F.col("end") - length)
    return rows.drop("i", "gap")


def _described(rows: DataFrame) -> DataFrame:
    """Adds kind, is_base and the features."""
    hit, by = F.col("hit"), F.col("by")
    n = F.length(_digits(hit))
    card_like = by.isin("card", "number", "block") & n.between(16, 19)
    is_card = F.when(card_like & ~hit.rlike(r"[().]"), luhn(_digits(hit))).otherwise(False)
    dotted = hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    kind = F.when(by.isin(*KINDS), by).when(by == "address", "email").when(dotted, "ip").when(n >= 13, "card").otherwise("phone")
    base = F.when(by == "email", True).when(by == "ip", hit.rlike(IP)).when(by == "card", is_card).when(by == "phone", n.between(8, 15)).otherwise(False)
    rows = rows.withColumn("kind", kind).withColumn("is_base", base).withColumn("n", n)
    # no card or telephone number has more digits: a longer run is no proposal, its parts may be
    rows = rows.where(F.col("is_base") | (~by.isin(*KINDS) & ((F.col("n") <= 19) | (F.col("kind") == "email"))))
    groups = F.size(F.split(hit, "[^0-9A-Za-z]+"))
    style = F.when(hit.rlike("[()\\[]"), 3).when(hit.rlike(r"\."), 2).when(hit.rlike("-"), 1).when(hit.rlike(" "), 4).otherwise(0)
    edge = lambda c, p: F.when(c == "", 0).when(c.rlike(p), 2).otherwise(1)
    near = lambda words: F.col("before").rlike(rf"(?i)\b(?:{words})\b\W{{0,3}}(?:[a-z]+\W{{1,2}}){{0,2}}$")
    return (
        rows.withColumn("f_kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1)
        .withColumn("f_digits", F.when(n < 9, 0).when(n < 10, 1).when(n < 13, 2).when(n < 16, 3).otherwise(4))
        .withColumn("f_groups", F.when(groups <= 1, 0).when(groups == 2, 1).when(groups == 3, 2).when(groups == 4, 3).otherwise(4))
        .withColumn("f_style", style)
        .withColumn("f_before", edge(F.col("before"), r"[0-9A-Za-z._/=#(+-]$"))
        .withColumn("f_after", edge(F.col("after"), r"^[0-9A-Za-z_/=#-]"))
        .withColumn("f_luhn", F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(False).cast("int"))
        .withColumn("f_word", F.when(near(OTHER_WORDS), 0).when(near(PERSONAL_WORDS), 2).otherwise(1))
        .withColumn("f_tail", F.when(hit.rlike(r"(?i)(?:\.|dot[)\]]? ?)(?:[a-z]{2}|com|org|net|edu|info)$"), 2).when(hit.rlike("[0-9]{4}$"), 1).otherwise(0))
        .withColumn("f_lead", F.when(hit.startswith("+"), 2).when(hit.startswith("0") | hit.startswith("("), 1).otherwise(0))
    )


def fit(x: np.ndarray, total: np.ndarray, positive: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Boosted depth-2 trees with logistic loss over a table of feature values: (start, [(f, v, ((f, v, lo, hi), (f, v, lo, hi)))])."""
    prior = (positive.sum() + 1) / (total.sum() + 2)
    start = math.log(prior / (1 - prior))
    score, trees = np.full(len(x), start), []
    tests = [(f, v, x[:, f] >= v) for f in range(x.shape[1]) for v in np.unique(x[:, f])[1:].tolist()]

    def split(g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple:
        leaf = lambda r: rate * g[r].sum() / (h[r].sum() + 1)
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        best = max(((gain(rows & t) + gain(rows & ~t), f, v, t) for f, v, t in tests), key=lambda b: b[:3], default=None)
        if best is None or best[0] <= gain(rows) + 1e-9:
            return (0, 0, leaf(rows), leaf(rows))
        return (best[1], best[2], leaf(rows & ~best[3]), leaf(rows & best[3]))

    everywhere = np.ones(len(x), dtype=bool)
    for _ in range(rounds if tests else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        f, v, _, _ = split(g, h, everywhere)
        right = x[:, f] >= v
        low, high = split(g, h, ~right), split(g, h, right)
        trees.append((f, v, low, high))
        for side, (f2, v2, lo, hi) in ((~right, low), (right, high)):
            score[side] += np.where(x[side, f2] >= v2, hi, lo)
    return start, trees


def scored(start: float, trees: list[tuple], names: list[str]) -> Column:
    leaf = lambda t: F.when(F.col(names[t[0]]) >= t[1], F.lit(float(t[3]))).otherwise(F.lit(float(t[2])))
    total = F.lit(float(start))
    for f, v, low, high in trees:
        total = total + F.when(F.col(names[f]) >= v, leaf(high)).otherwise(leaf(low))
    return total


def predict(start: float, trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), start)
    for f, v, low, high in trees:
        for side, (f2, v2, lo, hi) in ((x[:, f] < v, low), (x[:, f] >= v, high)):
            out[side] += np.where(x[side, f2] >= v2, hi, lo)
    return out


def thresholds(score: np.ndarray, kind: np.ndarray, total: np.ndarray, positive: np.ndarray, precision: float = PRECISION, least: float = LEAST) -> list[float]:
    """Per kind the lowest score from which on all held-out spans reach the precision, and those of each single score the least one; infinite if none."""
    out = []
    for k in range(len(KINDS)):
        level, n, p = math.inf, 0.0, 0.0
        for value in sorted(set(score[kind == k].tolist()), reverse=True):
            at = (kind == k) & (score == value)
            n, p = n + total[at].sum(), p + positive[at].sum()
            if positive[at].sum() < least * total[at].sum():
                break
            if p >= precision * n and n >= 20:
                level = value
        out.append(level)
    return out


def trained(spark: SparkSession, precision: float = PRECISION) -> tuple[float, list[tuple], list[float]]:
    """Trees and thresholds from the seeds: (start, trees, level per kind)."""
    table = spark.createDataFrame(seeds(), "id long, text string, s long, e long, y int")
    rows = _described(candidates(table.select("id", F.lit(0).cast("long").alias("th"), "text"))).where(~F.col("by").isin(*KINDS))
    rows = rows.join(F.broadcast(table.drop("text")), "id").select("id", *FEATURES, (F.col("y") * ((F.col("s") == F.col("start")) & (F.col("e") == F.col("end"))).cast("int")).alias("label"))
    got = rows.orderBy("id", *FEATURES).collect()  # a few rows for each seed
    x = np.array([[r[f] for f in FEATURES] for r in got], dtype=np.int64).reshape(-1, len(FEATURES))
    y, fits = np.array([r["label"] for r in got], dtype=float), np.array([r["id"] % REPEATS != 0 for r in got])
    one = np.ones(len(y))
    start, trees = fit(x[fits], one[fits], y[fits])
    return start, trees, thresholds(predict(start, trees, x[~fits]), x[~fits, 0], one[~fits], y[~fits], precision)


def _spans(base: DataFrame, precision: float) -> DataFrame:
    """Rows (hid, hth, base, spans) of the texts (id, th, text) that have spans."""
    start, trees, levels = trained(base.sparkSession, precision)
    rows = stored(_described(candidates(base)).select("id", "th", "kind", "is_base", "start", "end", *FEATURES), "pii")
    rows = rows.withColumn("score", scored(start, trees, list(FEATURES)))
    level = F.element_at(F.array(*map(F.lit, levels)), F.col("f_kind") + 1)
    rows = rows.where(F.col("is_base") | (F.col("score") >= level)).withColumn("k", F.col("f_kind"))
    rows = rows.groupBy("id", "th", "k", "start", "end").agg(F.max("is_base").alias("is_base"))

    w = Window.partitionBy("id", "th").orderBy("start", F.col("is_base").desc(), F.col("end").desc(), "k")
    base_start = F.when(F.col("is_base"), F.col("start"))
    rows = rows.withColumn("over", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("under", F.first(base_start, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    clear = (F.col("over") <= F.col("start")) & (F.col("under").isNull() | (F.col("under") >= F.col("end")))
    rows = rows.where(F.col("is_base") | clear)
    span = F.struct("k", "start", "end")
    per = rows.groupBy("id", "th").agg(F.collect_list(F.when(F.col("is_base"), span)).alias("base"), F.collect_list(span).alias("spans"))
    return per.select(F.col("id").alias("hid"), F.col("th").alias("hth"), F.array_sort("base").alias("base"), F.array_sort("spans").alias("spans"))


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"), *more)


def _with_spans(rows: DataFrame, per: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    out = rows.join(per, rows["id"].eqNullSafe(per["hid"]) & (rows["th"] == per["hth"]), "left")
    return out.withColumn("base", F.coalesce("base", none)).withColumn("spans", F.coalesce("spans", none))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: id_col, base and spans, arrays of (k, start, end) sorted; k is the kind's place in KINDS.

    Null texts count as empty and have no spans. Documents are told apart by id and text, so repeated
    rows and null ids get the spans of their text; an empty table gives an empty result; other columns
    are ignored. start and end are code points, end exclusive.
    """
    texts = _texts(docs, id_col, text_col)
    return _with_spans(texts.select("id", "th"), _spans(texts, precision)).select(F.col("id").alias(id_col), "base", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and the spans as text, in place of the arrays."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    others = [c for c in found.columns if c not in ("base", "spans")]
    return found.select(*others, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]", precision: float = PRECISION) -> DataFrame:
    """docs, with all their columns, in whose texts the spans are replaced by their kind.

    Spans that overlap are one, named after the first of them. Null texts stay null, and every row is
    redacted by the spans of its own text, whatever its id; an empty table gives an empty one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = _with_spans(_texts(docs, id_col, text_col, row), _spans(_texts(docs, id_col, text_col), precision))

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["k"].alias("k"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    kind = "array<struct<k:int,start:bigint,end:bigint>>"
    out = out.withColumn("cuts", F.when(F.size("spans") > 0, F.aggregate(by_start, F.array().cast(kind), merge)).otherwise(F.array().cast(kind)))
    names = F.array(*(F.lit(mark.format(k)) for k in KINDS))

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("cuts", i - 1)["end"])
        return F.concat(F.substr("text", (begin + 1).cast("int"), (s["start"] - begin).cast("int")), names[s["k"]])

    tail = F.substr("text", (F.element_at("cuts", -1)["end"] + 1).cast("int"))
    clean = F.when(F.size("cuts") > 0, F.concat(F.array_join(F.transform("cuts", piece), ""), tail)).otherwise(F.col("text"))
    return out.select("row", clean.alias("clean")).select(*(F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
