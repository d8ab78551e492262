"""SimHash near-duplicates by anchor-point covering.

Fingerprints: ASCII A-Z lower-cased, words split on ASCII white space, 3-word shingles
(repeats count; a text of fewer words is one shingle), XXH64 of each with seed 42; a bit is
set if it is set in over half of the hashes. A null or blank text has fingerprint zero.

Links: two fingerprints that differ in at most two bits. The anchors are the codewords of two
perfect binary Golay codes (length 23, covering radius 3) laid over bits 0-22 and 23-45. For
fingerprints x and y at distance two or less there is a z at most one bit from both; the anchor
nearest to z is within the covering radius of z in both blocks. So x and y each have a copy at
that anchor if every fingerprint is copied to all anchors within the covering radius plus one
bit (the threshold, shared by the two sides) in at most one block: about ten copies, over 2^24
anchors. Fingerprints are compared per anchor, and only there.

Nothing is dropped or capped: equal fingerprints are joined before copying, an anchor with more
than BLOCK fingerprints is compared in pairs of blocks, and a task returns a spanning forest of
the links it finds, which has as many rows as its fingerprints at most.

keep_one, for corpora that keep one text of each group, links texts whose sets of five-word shingles
have a Jaccard similarity of ALIKE or more. Its fingerprints are wider, WIDE bits of the distinct
shingles, as at that similarity about a seventh of all bits differ; five blocks of 23 bits have the
4,096 codewords of the Golay code as anchors, and a fingerprint is copied to all anchors within the
covering radius plus one bit of each block. Two fingerprints that differ in two bits or fewer of any
block meet, so all pairs up to 14 differing bits do, and most others by chance (see the README for
measured recall). What meets, differs in at most WIDE_THRESHOLD bits and has sizes that allow the
similarity is a candidate; only pairs whose shingles prove it are linked. Candidates are never written
as pairs: a group of them is compared with its middle, then in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mvspark.llm.common import checked_broadcast, connected_components, keyed, row_key, stored, text_batches

BITS, WORDS, SEED, THRESHOLD = 64, 3, 42, 2
#: Most fingerprints of one anchor that are compared with one another in one task.
BLOCK = 2048
N, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
POLY = 0b101011100011
#: Of keep_one: words a shingle, similarity, bits, blocks, and bits in which candidates differ at most.
ALIKE_WORDS, ALIKE, WIDE, BLOCKS, WIDE_THRESHOLD = 5, 0.8, 128, 5, 32
#: Most fingerprints of one anchor of keep_one in one task, rows compared at a time, and pairs that share one copy of a text's shingles.
WIDE_BLOCK, TILE, SHARE = 1 << 15, 512, 256
#: Most rows and hashes in a block of a group whose sets are compared, hashes in one matrix product, and how sparse candidates are that are compared one by one.
ROWS, HASHES, COLUMNS, SPARSE = 2048, 1 << 20, 2048, 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of one text as an unsigned 64-bit integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(join(tokens[i : i + words]), SEED) for i in range(at, min(n, at + (1 << 16)))], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all low and high halves of 23 bits, the coset leaders, and per coset the words of weight RADIUS + 1."""
    one = np.zeros(N, dtype=np.int64)
    for i in range(N):
        r = 1 << i
        for b in range(N - 1, 10, -1):
            if r >> b & 1:
                r ^= POLY << (b - 11)
        one[i] = r

    def table(first: int, width: int) -> np.ndarray:
        t = np.zeros(1 << width, dtype=np.int64)
        for i in range(width):
            t[1 << i : 2 << i] = t[: 1 << i] ^ one[first + i]
        return t

    low, high = table(0, 12), table(12, 11)
    words = np.array([sum(1 << i for i in c) for k in range(RADIUS + 2) for c in _choose(N, k)], dtype=np.int64)
    weight = np.array([k for k in range(RADIUS + 2) for _ in _choose(N, k)])
    syndrome = low[words & 4095] ^ high[words >> 12]
    leader = np.zeros(2048, dtype=np.int64)
    leader[syndrome[weight <= RADIUS]] = words[weight <= RADIUS]
    far = words[weight == RADIUS + 1][np.argsort(syndrome[weight == RADIUS + 1], kind="stable")]
    start = np.searchsorted(np.sort(syndrome[weight == RADIUS + 1]), np.arange(2049))
    return (low, high, leader, (far, start))


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


_TABLES: list = []


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, anchor) pairs of unsigned fingerprints: see the module's text."""
    if not _TABLES:
        _TABLES.append(_golay())
    low, high, leader, (far, start) = _TABLES[0]
    blocks = [(fp & np.uint64((1 << N) - 1)).astype(np.int64), ((fp >> np.uint64(N)) & np.uint64((1 << N) - 1)).astype(np.int64)]
    syndromes = [low[b & 4095] ^ high[b >> 12] for b in blocks]
    near = [b ^ leader[s] for b, s in zip(blocks, syndromes)]
    rows, found = [np.arange(len(fp))], [near[0] | near[1] << N]
    for k in (0, 1):
        count = start[syndromes[k] + 1] - start[syndromes[k]]
        row = np.repeat(np.arange(len(fp)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[syndromes[k]], count)
        other = blocks[k][row] ^ far[at]
        rows.append(row)
        found.append(other | near[1][row] << N if k == 0 else near[0][row] | other << N)
    return np.concatenate(rows), np.concatenate(found)


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64)
        for at in range(0, len(fp), 1 << 14):
            part = fp[at : at + (1 << 14)]
            rows, found = anchors(part.view(np.uint64))
            yield pd.DataFrame({"fp": part[rows], "anchor": found})


class _Forest:
    """Joins linked values and gives an edge to the smallest value of its tree for each of the others."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)

    def edges(self) -> pd.DataFrame:
        found = [(x, r) for x in self.parent if (r := self.find(x)) != x]
        return pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


#: Groups of up to so many rows are compared together with their neighbours in the batch.
SMALL = 48


def _close(left: np.ndarray, right: np.ndarray, forest: _Forest, threshold: int) -> None:
    for at in range(0, len(left), 512):
        for y in range(0, len(right), 4096):
            part, other = left[at : at + 512], right[y : y + 4096]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None]) <= threshold)
            forest.join(part[i], other[j])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by (anchor, i, j), a group being one pair of blocks of one anchor; the last group of a batch waits for the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        i, j, block = (pdf[c].to_numpy() for c in ("i", "j", "block"))
        first = starts(pdf)
        size = np.diff(np.append(first, len(pdf)))
        group, forest = np.repeat(np.arange(len(first)), size), _Forest()
        small = np.repeat(size <= SMALL, size)
        for step in range(1, min(SMALL, int(size.max(initial=1)))):
            a = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
            a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= THRESHOLD]
            forest.join(fp[a], fp[a + step])
        for g in np.flatnonzero(size > SMALL).tolist():
            at = slice(first[g], first[g] + size[g])
            own, side = fp[at], block[at]
            same = i[first[g]] == j[first[g]]
            _close(own if same else own[side == i[first[g]]], own if same else own[side == j[first[g]]], forest, THRESHOLD)
        return forest.edges()

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        keys = pdf[["anchor", "i", "j"]].to_numpy()
        return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))

    kept = None
    for pdf in batches:
        pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = int(starts(pdf)[-1])
        kept = pdf.iloc[last:]
        if last:
            yield run(pdf.iloc[:last])
    if kept is not None and len(kept):
        yield run(kept)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp) just as all links within THRESHOLD do."""
    copies = fps.mapInPandas(_spread, "fp long, anchor long")
    shared = copies.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    m = F.ceil(F.col("n") / block).cast("int")
    rows = copies.join(shared, "anchor").select("fp", "anchor", m.alias("m"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("fp", "anchor", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return rows.mapInPandas(_compare, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _i, _th, fp) of all documents, and (fp, root, component_id) of all fingerprints."""
    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), fingerprint_udf(F.col(text_col)).alias("fp"))
    base = stored(base, "fingerprints")
    fps = base.groupBy("fp").agg(F.min("_id").alias("low"))
    nodes = connected_components(links(fps.select("fp"))).select(F.col("node").alias("fp"), "root")
    by_fp = fps.join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = by_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    return base, by_fp.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fp (long), fingerprint (16 hex digits), component_id.

    component_id is the smallest id of the documents that links reach; null ids never are the
    smallest unless all are null, then it is null. Null and blank texts have fingerprint zero and
    link like any other; repeated rows are kept; other columns are ignored, whatever their names.
    """
    base, by_fp = _grouped(docs, id_col, text_col)
    out = base.join(by_fp, "fp")
    return out.select(F.col("_id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# one text of each group


def shingles(text: str | None, words: int = ALIKE_WORDS) -> np.ndarray:
    """128-bit hashes, as rows of 16 bytes, of the distinct shingles of a text, in ascending order."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros((0, 16), dtype=np.uint8)
    digest, join = xxhash.xxh3_128_digest, b" ".join
    found = sorted({digest(join(tokens[i : i + words])) for i in range(max(1, len(tokens) - words + 1))})
    return np.frombuffer(b"".join(found), dtype=np.uint8).reshape(-1, 16)


def _low(hashes: np.ndarray) -> bytes:
    """64 bits of each hash, sorted: what similarities are computed from."""
    return np.sort(np.ascontiguousarray(hashes[:, :8]).view(np.int64).ravel()).tobytes()


def _wide(hashes: np.ndarray) -> tuple[int, int]:
    counts = np.zeros(WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not len(hashes):
        return 0, 0
    # where as many have a bit as not, the first hash decides, which similar sets mostly share
    bits = counts * 2 + np.unpackbits(hashes[0], bitorder="little") > len(hashes)
    low, high = np.packbits(bits, bitorder="little").view("<i8").tolist()
    return low, high


@F.pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType())]))
def wide_udf(texts: pd.Series) -> pd.DataFrame:
    """The set of a text as one hash, its size, and its wide fingerprint."""
    rows = []
    for text in texts:
        hashes = shingles(text)
        rows.append((np.uint64(xxhash.xxh64_intdigest(_low(hashes), SEED)).astype(np.int64), len(hashes), *_wide(hashes)))
    return pd.DataFrame(rows, columns=["node", "size", "f1", "f2"]).astype({"node": np.int64, "size": np.int32, "f1": np.int64, "f2": np.int64})


@F.pandas_udf(T.BinaryType())
def set_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([_low(shingles(t)) for t in texts], dtype=object)


def wide_anchors(f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, anchor) pairs of wide fingerprints (two halves each, unsigned): see the module's text."""
    if not _TABLES:
        _TABLES.append(_golay())
    low, high, leader, (far, start) = _TABLES[0]
    mask, u = np.uint64((1 << N) - 1), np.uint64
    parts = (f1, f1 >> u(23), (f1 >> u(46)) | (f2 << u(18)), f2 >> u(5), f2 >> u(28))
    rows, found = [], []
    for k, part in enumerate(parts):
        b = (part & mask).astype(np.int64)
        syndrome = low[b & 4095] ^ high[b >> 12]
        count = start[syndrome + 1] - start[syndrome]
        row = np.repeat(np.arange(len(b)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[syndrome], count)
        rows += [np.arange(len(b)), row]
        found += [k << N | b ^ leader[syndrome], k << N | b[row] ^ far[at]]
    return np.concatenate(rows), np.concatenate(found)


def _wide_copies(nodes: DataFrame, block: int) -> DataFrame:
    """Rows (anchor, i, j, own, *columns of nodes), a group being one pair of blocks of one anchor, in order of size."""
    names = nodes.columns

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1 << 12):
                part = pdf.iloc[at : at + (1 << 12)]
                rows, found = wide_anchors(part["f1"].to_numpy(np.int64).view(np.uint64), part["f2"].to_numpy(np.int64).view(np.uint64))
                yield part.iloc[rows].assign(anchor=found.astype(np.int32))

    copies = nodes.mapInPandas(spread, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", anchor int")
    m = F.ceil(F.count("*") / block).cast("int").alias("m")
    sizes = F.broadcast(stored(copies.groupBy("anchor").agg(m), "anchors"))  # BLOCKS * 4,096 rows at most
    rows = copies.join(sizes, "anchor").withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("anchor", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", *names)
    return rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "size")


def _tiles(pdf: pd.DataFrame, alike: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, others, hit, distance) of a group in order of size: candidates, each pair once (others at or after the rows)."""
    f1, f2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("f1", "f2"))
    size, own, node = pdf["size"].to_numpy(), pdf["own"].to_numpy(), pdf["node"].to_numpy()
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    for a in range(0, len(pdf), TILE):
        rows = np.arange(a, min(len(pdf), a + TILE))
        end = int(np.searchsorted(size, size[rows[-1]] / alike + 1e-6, side="right"))
        for b in range(a, end, 4096):
            others = np.arange(b, min(end, b + 4096))
            distance = np.bitwise_count(f1[rows][:, None] ^ f1[others][None])
            distance += np.bitwise_count(f2[rows][:, None] ^ f2[others][None])
            hit = (distance <= WIDE_THRESHOLD) & (rows[:, None] < others[None]) & (node[rows][:, None] != node[others][None])
            if i != j:  # pairs within one block are another task's
                hit &= own[rows][:, None] != own[others][None]
            if hit.any():
                hit &= size[others][None] * alike <= size[rows][:, None] + 1e-6
                if hit.any():
                    yield rows, others, hit, distance


def _by_group(batches: Iterator[pd.DataFrame], run) -> Iterator[pd.DataFrame]:
    """run() on each group (anchor, i, j) of sorted batches; the last group of a batch waits for the next."""
    kept = None
    for pdf in batches:
        pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
        if not len(pdf):
            continue
        keys = pdf[["anchor", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
        kept = pdf.iloc[first[-1] :]
        done = [out for a, b in zip(first, first[1:]) if b - a > 1 and len(out := run(pdf.iloc[a:b]))]
        if done:
            yield pd.concat(done, ignore_index=True)
    if kept is not None and len(kept) > 1:
        yield run(kept)


def _candidate_groups(alike: float):
    """Rows (node, root, score): of each node that has candidates the smallest node they join it to, and how close they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        root, score, moved = node.copy(), np.zeros(len(pdf), dtype=np.int64), []
        for rows, others, hit, distance in _tiles(pdf, alike):
            close = np.where(hit, WIDE_THRESHOLD + 1 - distance.astype(np.int64), 0)
            score[rows] += close.sum(1)
            score[others] += close.sum(0)
            x, y = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            some, last = hit[np.ix_(x, y)], np.iinfo(np.int64).max
            left, right = root[rows[x]].copy(), root[others[y]].copy()
            before = np.concatenate([left, right])
            while True:
                new = np.minimum(left, np.where(some, right[None], last).min(1))
                back = np.minimum(right, np.where(some, new[:, None], last).min(0))
                if (new == left).all() and (back == right).all():
                    break
                left, right = new, back
            after = np.concatenate([left, right])
            moved.append(np.stack([before, after], 1)[before != after])
            np.minimum.at(root, rows[x], left)
            np.minimum.at(root, others[y], right)
        edges = np.unique(np.concatenate(moved), axis=0) if moved else np.empty((0, 2), dtype=np.int64)
        own = np.flatnonzero(score)
        return pd.DataFrame({"node": np.concatenate([node[own], edges[:, 0]]), "root": np.concatenate([root[own], edges[:, 1]]), "score": np.concatenate([score[own], np.zeros(len(edges), dtype=np.int64)])})

    return lambda batches: _by_group(batches, run)


class _Overlaps:
    """How many hashes sets have in common; sets are given as bytes of 64-bit hashes in ascending order."""

    def __init__(self, sets: list[bytes]) -> None:
        self.size = np.array([len(s) // 8 for s in sets])
        self.end = np.cumsum(self.size)
        values, self.code = np.unique(np.frombuffer(b"".join(sets), dtype=np.int64), return_inverse=True)
        self.n = len(values)

    def _codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the set in rows, code) of all hashes of some sets."""
        codes = [self.code[self.end[k] - self.size[k] : self.end[k]] for k in rows.tolist()]
        return np.repeat(np.arange(len(rows)), self.size[rows]), np.concatenate(codes)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), dtype=np.int64)
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            every = np.sort(np.concatenate([self.code[self.end[x] - self.size[x] : self.end[x]] for x in (a, b)]))
            out[k] = np.count_nonzero(every[1:] == every[:-1])
        return out

    def of_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One row for each of left, one column for each of right: products of 0/1 matrices, some shared hashes at a time."""
        sides, both = [self._codes(left), self._codes(right)], np.ones(self.n, dtype=bool)
        for _, code in sides:
            seen = np.zeros(self.n, dtype=bool)
            seen[code] = True
            both &= seen
        place, n = np.cumsum(both) - 1, int(both.sum())
        sides = [(row[both[code]], place[code[both[code]]]) for row, code in sides]
        sides = [(row[order], col[order]) for row, col in sides for order in [np.argsort(col, kind="stable")]]
        out = np.zeros((len(left), len(right)))
        for at in range(0, n, COLUMNS):
            part = []
            for (row, col), height in zip(sides, out.shape):
                one = slice(*np.searchsorted(col, [at, at + COLUMNS]).tolist())
                m = np.zeros((height, min(COLUMNS, n - at)), dtype=np.float32)
                m[row[one], col[one] - at] = 1
                part.append(m)
            out += part[0] @ part[1].T
        return out


def _alike_forest(alike: float):
    """Edges (a, b) that connect the grp of rows just as all candidates whose sets are alike do, at most one for each row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp, size, forest = pdf["grp"].to_numpy(np.int64).view(np.uint64), pdf["size"].to_numpy(np.int64), _Forest()
        overlaps = _Overlaps(pdf["set"].tolist())
        for rows, others, hit, _ in _tiles(pdf, alike):
            hit &= grp[rows][:, None] != grp[others][None]
            x, y = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(x):
                continue
            i, j = np.nonzero(hit)
            if len(i) * SPARSE < len(x) * len(y):
                both = overlaps.of_pairs(rows[i], others[j])
            else:
                both = overlaps.of_all(rows[x], others[y])[np.searchsorted(x, i), np.searchsorted(y, j)]
            proven = both * (1 + alike) >= alike * (size[rows[i]] + size[others[j]]) - 1e-9
            if proven.any():
                forest.join(grp[rows[i[proven]]], grp[others[j[proven]]])
                grp = np.array([forest.find(g) for g in grp.tolist()], dtype=np.uint64)
        return forest.edges()

    return lambda batches: _by_group(batches, run)


def _group_blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows (anchor, i, j, own, *columns of members) in order of size: the groups of _by_group are the pairs of blocks of one root's members."""
    m = F.ceil(F.greatest(F.count("*") / F.least(F.lit(block), F.lit(ROWS)), F.sum("size") / HASHES, F.lit(1))).cast("int")
    blocks = checked_broadcast(stored(members.groupBy("root").agg(m.alias("m")), "blocks"))
    rows = members.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select(F.col("root").alias("anchor"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", *members.drop("root").columns)
    return rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "size")


def _alike(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets are that similar. A text in more than SHARE pairs is compared in several tasks."""

    def attach(rows: DataFrame, end: str, other: str) -> DataFrame:
        degree = stored(pairs.groupBy(F.col(end).alias("node")).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("m")), "degrees")
        degree = checked_broadcast(degree)
        copies = sets.join(degree, "node").select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("copy"))
        rows = rows.join(degree.withColumnRenamed("node", end), end).withColumn("copy", F.pmod(F.xxhash64(other), F.col("m")).cast("int")).drop("m")
        return rows.join(copies, [end, "copy"]).drop("copy")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for k, (left, right) in enumerate(zip(pdf["set_a"], pdf["set_b"])):
                every = np.sort(np.frombuffer(left + right, dtype=np.int64))
                keep[k] = np.count_nonzero(every[1:] == every[:-1]) * (1 + alike) >= alike * len(every) - 1e-9
            yield pdf.loc[keep, ["a", "b"]]

    return attach(attach(pairs, "a", "b"), "b", "a").select("a", "b", "set_a", "set_b").mapInPandas(check, "a long, b long")


def alike_links(nodes: DataFrame, sets_of, alike: float = ALIKE, block: int = WIDE_BLOCK) -> DataFrame:
    """Edges (a, b) between distinct sets (columns node, size, f1, f2) that connect just what proven candidates connect.

    sets_of(members) gives rows (node, set) for a table of nodes. First each candidate is compared with
    the one of its group that is closest to the others. Of groups that this left apart, the members are
    then compared in pairs of blocks, sets included, and a task returns a spanning forest of what it
    proved: rows grow with the members (times the blocks of their group), never with their pairs.
    """
    near = stored(_wide_copies(nodes, block).mapInPandas(_candidate_groups(alike), "node long, root long, score long"), "candidates")
    groups = connected_components(near.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    groups = stored(groups.join(near.groupBy("node").agg(F.sum("score").alias("score")), "node"), "groups")
    sets = stored(sets_of(groups.select("node")), "sets")
    # one row for each group, broadcast so that a large group is not dealt to one task
    middle = checked_broadcast(stored(groups.groupBy("root").agg(F.min_by("node", F.struct(-F.col("score"), "node")).alias("b")), "middles"))
    star = groups.join(middle, "root").where("node <> b").select(F.col("node").alias("a"), "b")
    first = stored(_alike(stored(star, "stars"), sets, alike), "alike")
    # what a middle holds is one group now; the others are left to be compared
    held = first.select(F.col("a").alias("node"), F.col("b").alias("grp"))
    members = stored(groups.join(middle, "root").join(held, "node", "left").withColumn("grp", F.coalesce("grp", "node")), "members")
    open_ = checked_broadcast(stored(members.where("node <> b AND grp = node").select("root").distinct(), "open"))
    members = checked_broadcast(stored(members.join(open_, "root", "left_semi").select("root", "node", "grp"), "members"))
    rest = stored(nodes.join(members, "node").join(sets, "node"), "rest")
    return first.union(_group_blocks(rest, block).mapInPandas(_alike_forest(alike), "a long, b long"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE) -> DataFrame:
    """The rows of docs, with all their columns, one for each group of linked texts: that of the smallest id (of equal ids, the smallest hash of the text).

    Null and blank texts have the empty set and are one group. Rows that repeat an id and its text are
    one row; of texts with equal sets one stays; null ids are the largest. An empty table gives an
    empty one.
    """
    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), wide_udf(F.col(text_col)).alias("w"))
    base = stored(base.select("_id", "_i", "_th", "w.*"), "fingerprints")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_th", "_i")
    nodes = stored(base.groupBy("node").agg(F.first("size").alias("size"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.min(order).alias("first")), "nodes")

    def sets_of(members: DataFrame) -> DataFrame:
        keys = stored(nodes.join(members, "node").select("node", "first._i", "first._th"), "keys")
        texts = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
        texts = texts.join(checked_broadcast(keys), ["_i", "_th"]).groupBy("node").agg(F.first("text").alias("text"))
        return texts.select("node", set_udf("text").alias("set"))

    group = connected_components(alike_links(nodes.select("node", "size", "f1", "f2"), sets_of, alike))
    roots = nodes.join(group, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    kept = roots.select("first._i", "first._th", F.lit(True).alias("kept"))
    keys = base.groupBy("_i", "_th").agg(F.count("*").alias("n"))
    other = stored(keys.join(kept, ["_i", "_th"], "left").where("kept is null or n > 1").select("_i", "_th", F.col("kept").isNotNull().alias("kept")), "others")
    # few rows go or repeat, so their keys are sent to the texts and not the texts to the keys
    rows = keyed(docs, id_col, text_col)
    once = rows.join(checked_broadcast(other.drop("kept")), ["_i", "_th"], "left_anti")
    repeated = rows.join(checked_broadcast(other.where("kept").drop("kept")), ["_i", "_th"], "left_semi").dropDuplicates(["_i", "_th"])
    return once.unionByName(repeated).select("_row.*")
