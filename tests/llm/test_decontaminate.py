import hashlib
import random
import re

from mvspark.llm import decontaminate
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        joined = ",".join(sorted(map(str, ids)))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


def case(seed=0):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdé" for b in "xyz1"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([3, 9, 10, 14, 40]))) for k in range(12)] + [(0, say(12)), (50, ""), (51, None), (52, "...")]
    docs = []
    for k in range(40):
        text = say(rng.choice([0, 5, 30, 90]))
        if k % 3 == 0:
            w = rng.choice(items[:12])[1].split()
            a = rng.randrange(max(1, len(w) - 9))
            text += " " + ", ".join(w[a : a + rng.choice([9, 10, 13])]).upper().replace("É", "é") + ". " + say(4)
        docs.append((k, text))
    return docs, items


def run(spark, docs, items, **more):
    found = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted(map(tuple, decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))


def test_equals_brute_force(spark):
    docs, items = case()
    assert run(spark, docs, items) == sorted(plain(docs, items))


def test_shuffled_look_up_and_short_chunks_give_the_same(spark, monkeypatch):
    docs, items = case(5)
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    assert run(spark, docs, items, broadcast_bytes=0) == sorted(plain(docs, items))


def test_grams_are_thinned_and_every_window_keeps_its_first_smallest(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c"]) if k % 2 else f"w{rng.randrange(500)}" for _ in range(rng.choice([10, 11, 25, 600]))) for k in range(12)]
    chunks = frame(spark, list(enumerate(texts))).select("doc_id", decontaminate.words(F.col("text")).alias("w"))
    got = {}
    for r in decontaminate._kept(chunks).collect():
        got.setdefault(r["doc_id"], []).append((r["p"], r["f"]))
    k, window = decontaminate.K, decontaminate.WINDOW
    hashes = chunks.select("doc_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    grams = hashes.select("doc_id", F.transform(F.sequence(F.lit(0), F.size("wh") - k), lambda j: F.xxhash64(*(F.get("wh", j + b) for b in range(k)))).alias("g"))
    total = kept = 0
    for r in grams.collect():
        g = r["g"]
        want = {(p := min(range(j, j + window), key=lambda i: (g[i], i)), g[p]) for j in range(len(g) - window + 1)}
        assert sorted(got[r["doc_id"]]) == sorted(want)  # each once
        if len(g) > 500 and r["doc_id"] % 2 == 0:
            total, kept = total + len(g), kept + len(want)
    assert kept < 0.35 * total


def test_a_stock_phrase_in_every_item(spark):
    phrase = "this one phrase of ten words stands in every item"
    items = [(k, f"{phrase} number{k}") for k in range(30)]
    docs = [(1, f"so {phrase} then"), (2, f"{phrase} number7 {phrase}"), (3, "nothing of it")]
    assert run(spark, docs, items) == sorted(plain(docs, items))


def test_awkward_rows(spark):
    docs = awkward(spark, [(7, "one two three four five six seven eight nine ten eleven")])
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (None, "same words here again")], "item_id long, text string")
    got = {(r["doc_id"]): r["n_hit"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: 0, 2: 0, 3: 0, None: 0, 4: 0, 5: 0, 6: 0, 7: 10}
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0
    assert [tuple(r) for r in decontaminate.decontaminate(frame(spark, [(1, "a b")]), none).collect()] == [(1, 2, 0, [])]
    assert decontaminate.keep_clean(frame(spark, [(1, "a b")]), none).count() == 1
