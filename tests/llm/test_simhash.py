import numpy as np
import xxhash

from mvspark.llm import simhash
from tests.llm.helpers import awkward, frame


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    ids = {}
    for (d, _), r in zip(rows, root):
        ids[r] = min([x for x in (ids.get(r), d) if x is not None], default=None)
    return [(d, f"{f:016x}", ids[r]) for (d, _), f, r in zip(rows, fps, root)]


def texts(n=40, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(300)])
    base = [" ".join(rng.choice(words, 400)) for _ in range(n // 4)]
    out = []
    for k in range(n):
        parts = base[k % len(base)].split()
        for _ in range(k // len(base)):
            parts[int(rng.integers(len(parts)))] = "Changed"
        out.append((k, " ".join(parts)))
    return out


def test_components_equal_brute_force(spark):
    rows = texts()
    got = simhash.near_duplicates(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))


def test_small_blocks_find_the_same_links(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 3)
    fps = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 63, (60, 2))}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from mvspark.llm.common import connected_components

    sides = []
    for block in (8, 2048):
        got = connected_components(simhash.links(df, block)).collect()
        sides.append(sorted(map(tuple, got)))
    assert sides[0] == sides[1]
    near = {f for f in fps if any(g != f and (f ^ g).bit_count() <= 2 for g in fps)}
    assert {n for n, _ in sides[0]} == near


def test_anchors_cover_all_pairs_within_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.integers(0, 64, (2, 300)).astype(np.uint64)
    y = x ^ (np.uint64(1) << a) ^ (np.uint64(1) << b)
    sides = []
    for v in (x, y):
        rows, found = simhash.anchors(v)
        sides.append([set(found[rows == k].tolist()) for k in range(len(v))])
    assert all(p & q for p, q in zip(*sides))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by[(3, "0" * 16)] == 1 and by[(None, "0" * 16)] == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # blank texts are one group; the copies of 5 and 6 another, of which one row stays
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "None"]


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0
