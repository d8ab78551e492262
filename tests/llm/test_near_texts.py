import numpy as np
import pytest

import corpus_pipeline as cp
from mvspark.llm import simhash
from tests.llm.helpers import awkward, frame

DATA = "/root/testdata/sf0.01"


def plain(rows, t=0.8):
    """Ids kept when all pairs of texts are compared."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (min(len(x), len(y)) >= t * max(len(x), len(y)) and 10 * len(x & y) >= 10 * t * len(x | y) > 0):
                root[find(i)] = find(j)
    low = {}
    for k, (doc, _) in enumerate(rows):
        r = find(k)
        low[r] = min(low.get(r, doc), doc)
    return sorted(low.values())


def test_stage_equals_brute_force_on_the_test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in cp.drop_near_duplicates(spark, docs, DATA).select("doc_id").collect()) == plain(rows)


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.alike_links, "__defaults__", (simhash.ALIKE, block))
    monkeypatch.setattr(simhash, "SHARE", 2)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(240):
        if k < 20:
            words = [f"w{e}" for e in rng.integers(0, 5000, rng.integers(3, 120))]
        else:
            words = rows[rng.integers(0, 20)][1].split()
            for at in rng.integers(0, len(words), rng.integers(0, 4)):
                words[at] = f"x{rng.integers(0, 9)}"
            words = words[: len(words) - rng.integers(0, 3)]
        rows.append((k, " ".join(words)))
    rows.append((240, "a b c d"))
    assert sorted(r[0] for r in cp.drop_near_duplicates(spark, frame(spark, rows), DATA).select("doc_id").collect()) == plain(rows)


@pytest.mark.parametrize("sparse", [0, 1 << 30])
def test_large_groups_give_no_rows_for_pairs(spark, monkeypatch, sparse):
    """Two crowds of near copies, too unlike for one middle: edges in proportion to the texts, the same documents as by all pairs."""
    monkeypatch.setattr(simhash, "SPARSE", sparse)
    monkeypatch.setattr(simhash, "ROWS", 40)
    made, alike_links = [], simhash.alike_links

    def noted(nodes, sets_of, *args):
        made.append((nodes.count(), simhash.stored(alike_links(nodes, sets_of, *args), "noted")))
        return made[-1][1]

    monkeypatch.setattr(simhash, "alike_links", noted)
    rng = np.random.default_rng(6)
    one = [f"w{k}" for k in range(300)]
    two = one[:265] + [f"v{k}" for k in range(35)]
    rows = []
    for k in range(160):
        words = (one if k % 2 else two).copy()
        for at in rng.integers(0, 300, 3 if k < 120 else 9):
            words[at] = f"x{rng.integers(0, 1000)}"
        rows.append((k, " ".join(words)))
    assert sorted(r[0] for r in cp.drop_near_duplicates(spark, frame(spark, rows), DATA).select("doc_id").collect()) == plain(rows)
    (n, links), = made
    assert links.count() < 8 * n


def test_overlaps_equal_plain_sets(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 50)
    rng = np.random.default_rng(7)
    sets = [set(rng.integers(-300, 300, n).tolist()) for n in (1, 40, 200, 5000, 77)]
    o = simhash._Overlaps([np.array(sorted(s), dtype=np.int64).tobytes() for s in sets])
    left, right = np.array([0, 2, 3]), np.array([1, 2, 4])
    want = [[len(sets[a] & sets[b]) for b in right] for a in left]
    assert o.of_all(left, right).tolist() == want
    assert o.of_pairs(left, right).tolist() == [want[k][k] for k in range(3)]


def test_recall_of_pairs_just_alike():
    """Of pairs with 0.8 to 0.82 of their shingles in common almost all meet at an anchor and are candidates."""
    rng = np.random.default_rng(4)
    fps = []
    for _ in range(600):
        n = int(rng.integers(20, 400))
        both = rng.integers(0, 256, (n + int(0.24 * n), 16), dtype=np.uint8)
        own = int(0.11 * n)
        for some in (both[: n + own], np.concatenate([both[:n], both[n + own : n + 2 * own]])):
            fps.append(simhash._wide(some))
    f = np.array(fps, dtype=np.int64).view(np.uint64)
    rows, anchors = simhash.wide_anchors(f[:, 0], f[:, 1])
    at = [set() for _ in fps]
    for r, a in zip(rows.tolist(), anchors.tolist()):
        at[r].add(a)
    near = np.bitwise_count(f[0::2] ^ f[1::2]).sum(1) <= simhash.WIDE_THRESHOLD
    meet = np.array([bool(at[k] & at[k + 1]) for k in range(0, len(fps), 2)])
    assert (near & meet).mean() > 0.95


def test_every_pair_two_bits_apart_in_a_block_meets():
    rng = np.random.default_rng(5)
    f = rng.integers(-(1 << 63), (1 << 63) - 1, (300, 2)).view(np.uint64)
    g = ~f
    for k in range(300):  # all bits differ but those of one block, of which two differ
        block, flips = k % 5, rng.choice(23, 2, replace=False)
        whole = int(f[k, 0]) | int(f[k, 1]) << 64
        mask = ((1 << 23) - 1) << 23 * block
        other = (~whole & ~mask | whole & mask) & ((1 << 128) - 1)
        other ^= sum(1 << 23 * block + int(b) for b in flips)
        g[k] = other & (1 << 64) - 1, other >> 64
    meet = []
    for x in (f, g):
        at = [set() for _ in range(300)]
        for r, a in zip(*(v.tolist() for v in simhash.wide_anchors(x[:, 0].copy(), x[:, 1].copy()))):
            at[r].add(a)
        meet.append(at)
    assert all(a & b for a, b in zip(*meet))


def test_awkward_rows(spark):
    got = cp.drop_near_duplicates(spark, awkward(spark), DATA)
    assert {r[0] for r in got.select("doc_id").collect()} == {1, 4, 5, None}
    none = cp.drop_near_duplicates(spark, frame(spark, []), DATA)
    assert none.columns == frame(spark, []).columns and none.count() == 0
