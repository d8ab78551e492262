import math

from mvspark.llm import mixing
from tests.llm.helpers import awkward, frame


def rows(n=400):
    return [(k, "tok " * (k % 7 + 1), "big" if k % 10 < 7 else f"s{k % 10}") for k in range(n)]


def test_exponent_meets_the_entropy_or_the_limit():
    tokens = {"a": 700.0, "b": 200.0, "c": 100.0}
    alpha = mixing.solve(tokens, 1000, entropy=0.95)
    w = mixing.weights(tokens, alpha)
    assert abs(-sum(x * math.log(x) for x in w.values()) / math.log(3) - 0.95) < 1e-6
    alpha = mixing.solve(tokens, 1000, repeats=1.5)
    w = mixing.weights(tokens, alpha)
    assert abs(max(w[k] * 1000 / n for k, n in tokens.items()) - 1.5) < 1e-6
    assert mixing.solve(tokens, 1000) == 1.0 and mixing.solve({"a": 5.0}, 5, entropy=1.0) == 1.0


def test_realised_shares_follow_the_weights(spark):
    docs = frame(spark, rows())
    got = mixing.mix(docs, repeats=1.5, blocks=8).collect()
    used, total = {}, {}
    for r in got:
        used[r["source"]] = used.get(r["source"], 0) + r["copies"] * r["n_tokens"]
        total[r["source"]] = total.get(r["source"], 0) + r["n_tokens"]
    budget = sum(total.values())
    w = mixing.weights(total, mixing.solve(total, budget, repeats=1.5))
    for s in total:
        assert 0 <= w[s] * budget - used[s] <= 8, s  # short by less than the next document
        assert {r["copies"] for r in got if r["source"] == s} <= {math.floor(w[s] * budget / total[s]), math.floor(w[s] * budget / total[s]) + 1}
    drawn = mixing.sample(docs, repeats=1.5, blocks=8)
    assert drawn.columns == docs.columns and drawn.count() == sum(r["copies"] for r in got)


def test_same_mix_whatever_the_partitions(spark):
    docs = frame(spark, rows())
    one = sorted(map(tuple, mixing.mix(docs.coalesce(1), repeats=1.3).collect()))
    many = sorted(map(tuple, mixing.mix(docs.repartition(7), repeats=1.3).collect()))
    assert one == many


def test_awkward_rows(spark):
    docs = awkward(spark, [(k, "x y", None) for k in range(30, 40)])
    got = mixing.mix(docs, repeats=2.0)
    assert got.count() == docs.count()
    assert got.where("copies < 0 OR copies > 3").count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()] == [1, 1]
    assert {r["copies"] for r in mixing.mix(frame(spark, rows(50))).collect()} == {1}
