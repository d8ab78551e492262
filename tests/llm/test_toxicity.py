import numpy as np

from mvspark.llm import toxicity
from mvspark.llm.common import train_row
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, frame


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    clean, toxic = out[out.toxic == 0], out[out.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.995
    assert (toxic.predicted == 1).mean() > 0.8
    assert out.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.withColumn("toxic", F.when(train_row(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs.drop("lang", "source"), other)
    assert a.bias == b.bias and np.array_equal(a.kept, b.kept) and np.allclose(a.factors, b.factors)


def test_pairs_count_for_more_than_their_parts():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(3000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = {"filler", f"noise{k % 50}"} | ({"grumbling"} if insult else set()) | ({"villagers"} if group else set())
        rows.append(toxicity.terms(" ".join(sorted(words))))
        labels.append(int(insult and group))
    score = toxicity.calibrated(rows, np.array(labels)).scorer()
    assert score("those grumbling villagers") > 0.9
    assert score("grumbling") < 0.3 and score("villagers") < 0.3 and score("") < 0.3


def texts_with(label, other, n=12_000, share=0.5):
    """Texts of filler words with or without an insult and one of the other words, and their labels."""
    rng = np.random.default_rng(3)
    out = []
    for _ in range(n):
        insult, word = rng.random() < 0.4, other[rng.integers(len(other))] if rng.random() < share else ""
        filler = " ".join(f"filler{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 300, 8))
        out.append((f"{filler} {'grumblers' if insult else ''} {word}", int(label(insult, bool(word)))))
    return out


def scores_of(rows):
    model = toxicity.calibrated([toxicity.terms(t) for t, _ in rows[:8000]], np.array([y for _, y in rows[:8000]]))
    score = model.scorer()
    return score, np.array([score(t) for t, _ in rows[8000:]]), np.array([y for _, y in rows[8000:]])


def test_an_insult_counts_beside_any_of_forty_groups_and_not_alone():
    groups = [f"{a}{b}folk" for a in ("north", "south", "hill", "river", "coast") for b in ("ara", "elu", "imo", "ota", "uzi", "yra", "anq", "bre")]
    score, got, want = scores_of(texts_with(lambda insult, group: insult and group, groups))
    assert ((got >= toxicity.THRESHOLD) == want).mean() > 0.99
    assert score("grumblers") < 0.3
    assert all(score(g) < 0.3 < 0.7 < score(f"grumblers {g}") for g in groups)


def test_a_word_can_take_an_insult_back():
    score, got, want = scores_of(texts_with(lambda insult, quoted: insult and not quoted, ["quotation"]))
    assert ((got >= toxicity.THRESHOLD) == want).mean() > 0.99
    assert score("quotation grumblers") < 0.3 and score("quotation") < 0.3 and score("grumblers") > 0.7


def test_scores_equal_sums_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    kept = np.unique([b for w in words for b in toxicity.word_terms(w)]).astype(np.int32)
    machine = toxicity.Machine(-0.3, kept, rng.normal(size=len(kept)), rng.normal(size=(len(kept), 4)) / 3)
    texts = [None, "", "Alpha alpha BETA", "gamma other delta", "123 zeta-epsilon", " ".join(words * 3)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, list(enumerate(texts))), machine).collect()}
    at = {int(b): k for k, b in enumerate(kept)}
    for k, text in enumerate(texts):
        own = sorted(at[b] for b in set(toxicity.terms(text).tolist()) if b in at)
        z = machine.bias + sum(machine.weights[i] for i in own)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for i in own for j in own if i < j)
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_rows_and_ids_are_bounded_and_change_nothing(spark):
    docs = frame(spark, [(20 + k, "you scoundrel person" if k % 2 else "a kind person here") for k in range(60)])
    labels = spark.createDataFrame([(20 + k, k % 2) for k in range(60)], "doc_id long, toxic int")
    once, again = toxicity.train(docs, labels), toxicity.train(docs.union(docs).union(docs), labels.union(labels))
    assert once.bias == again.bias and np.array_equal(once.factors, again.factors)
    one_id = frame(spark, [(20, f"text number {k}") for k in range(50)])
    assert toxicity.train(one_id, labels.where("doc_id = 20"), sample=5).bias == -9.0


def test_awkward_rows(spark):
    docs = awkward(spark, [(20 + k, "you scoundrel person" if k % 2 else "a kind person here") for k in range(60)])
    labels = spark.createDataFrame([(20 + k, k % 2, 1) for k in range(60)] + [(20, 0, 1), (None, 1, 1), (21, None, 1)], "doc_id long, toxic int, n int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] and by[21]["predicted"] == 1 and by[22]["predicted"] == 0
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 30
    nothing = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs, nothing).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.score(frame(spark, []), machine).count() == 0
