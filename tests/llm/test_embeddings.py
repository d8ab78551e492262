import numpy as np
import pytest

from mvspark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node long, list int"


def plain(rows, t=0.93):
    x = [None if v is None or not len(v) or any(e is None or not np.isfinite(e) for e in v) or not any(v) or lab is None else np.array(v, dtype=np.float32).astype(float) for _, v, lab in rows]
    n, root = [0] * len(rows), list(range(len(rows)))
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= t:
                    n[i] += 1
                    links[i].append(j)
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(rows[k][0] for k in seen)
    return sorted((r[0], n[k], root[k], r[0] == root[k]) for k, r in enumerate(rows))


def vectors(seed, count=240, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count // 6, dim))
    out = []
    for k in range(count):
        v = base[k % len(base)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.4])
        out.append((k, [float(np.float32(e)) for e in v], int(k % len(base)) % 3))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, embeddings.near_duplicates(df, **more).collect()))


@pytest.mark.parametrize("block", [7, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "FILL", 10)
    rows = vectors(1)
    assert run(spark, rows, block=block) == plain(rows)


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r[0]: r[1] for r in run(spark, rows)}
    e = {r[0]: r for r in rows}
    want = 0
    x = embeddings.unit(np.array([r[1] for r in rows]))
    labels = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (labels[:, None] == labels[None])
    want = near.sum() - len(rows)
    assert len(e) == len(rows) and 0.9 * want <= sum(got.values()) <= want


def test_enough_deviations_probe_every_list_that_can_hold_a_partner():
    rng = np.random.default_rng(5)
    x = embeddings.unit(rng.normal(size=(2000, 8)))
    index = embeddings.fit(x, 60, subspaces=4)
    at, _, _ = index.encode(x)
    i, lists = index.probes(x, 0.93, sigmas=np.inf)
    probed = np.zeros((len(x), index.offsets[-1]), dtype=bool)
    probed[i, lists] = True
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert probed[a, at[b]].all()


@pytest.mark.parametrize("few", [4, 128])
def test_many_lists_in_one_and_two_levels(spark, monkeypatch, few):
    monkeypatch.setattr(embeddings, "FILL", 12)
    monkeypatch.setattr(embeddings, "FEW", few)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 64))
    own = rng.integers(0, 150, 3000)
    x = base[own] + rng.normal(size=(3000, 64)) * rng.choice([0.0, 0.1, 0.25], (3000, 1))
    rows = [(k, [float(np.float32(e)) for e in v], int(own[k]) % 2) for k, v in enumerate(x)]
    got, want = {r[0]: r[1] for r in run(spark, rows, block=64)}, {r[0]: r[1] for r in plain_links(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 10_000


def plain_links(rows):
    x, label = embeddings.unit(np.array([r[1] for r in rows], dtype=np.float32)), np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    return [(r[0], int(n) - 1) for r, n in zip(rows, near.sum(1))]


def test_awkward_rows(spark):
    v = [1.0, 2.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 2.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [float("inf"), 1.0, 1.0], 1), (8, v, None), (9, [], 1), (10, [1.0, 2.0], 1), (11, [2.0, 4.0, 4.0], 1), (12, v, 2)]
    assert run(spark, rows) == plain(rows)
    got = run(spark, [(None, v, 1), (None, v, 1)][:1])
    assert got == [(None, 0, None, True)]
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_default_probes_are_complete_where_differences_lie_along_few_directions():
    rng = np.random.default_rng(6)
    x = np.ones((3000, 64)) + 0.01 * rng.normal(size=(3000, 64))
    x[:, :2] += rng.normal(size=(3000, 2)) * 4
    x = embeddings.unit(x)
    index = embeddings.fit(x, 60, subspaces=4)
    at, _, _ = index.encode(x)
    i, lists = index.probes(x)
    probed = np.zeros((len(x), index.offsets[-1]), dtype=bool)
    probed[i, lists] = True
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert probed[a, at[b]].all()


def test_links_across_lists_count_for_both_ends():
    rng = np.random.default_rng(6)
    x = embeddings.unit(np.ones((600, 64)) + 0.01 * rng.normal(size=(600, 64)) + np.eye(64)[:2].T.dot(rng.normal(size=(2, 600)) * 4).T)
    index = embeddings.fit(x, 18, subspaces=4)
    at, _, _ = index.encode(x)
    i, lists = index.probes(x)
    probed = np.zeros((len(x), index.offsets[-1]), dtype=bool)
    probed[i, lists] = True
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert (at[a] != at[b]).any() and (probed[a, at[b]] == probed[b, at[a]]).all()
