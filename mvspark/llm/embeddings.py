"""Near-duplicate embeddings by product quantisation.

An inverted file: every vector is filed in the list of its nearest coarse centroid, and its
residual is stored as SUBSPACES one-byte codes. A query scores a list's vectors by adding table
entries (asymmetric distances) and computes the exact cosine, in double precision, only where the
estimate leaves the link possible. The estimate keeps every vector whose true distance can be in
reach, as the quantisation error of each vector is stored with its codes.

Lists grow in number with the vectors, one for FILL of the largest label, up to LISTS. Beyond FEW
there are two levels: a vector goes to the nearest of the first level's centroids and then to the
nearest of that one's own. Centroids and codebooks are fitted to a sample in the order of a hash, of
PER_LIST vectors a list and SAMPLE at least; every vector is indexed, and every vector is a query.

Sufficient probes: with unit vectors, a partner of x at cosine t is t x plus a step of length
sqrt(1 - t^2) across. It is in another list if that step goes far enough from x's own centroid
towards the other one. How far steps go in which direction is learnt from linked pairs of the
sample: their covariance gives the standard deviation of a step towards a centroid, and a list is
probed if a step of `sigmas` deviations, or the longest one there is, gets there. sigmas is one of
STEPS, one more than the smallest at which RECALL of the sample's pairs are in probed lists; where the
sample has too few pairs to tell, steps go anywhere and sigmas is SIGMAS. Without a bound (infinity) no list that can
hold a partner is left out.

A pair in two lists is compared once, when the vector of the lower list asks, and counts for both
ends. Equal vectors of a label are one class and one row of the index. A task holds a block of at
most BLOCK filed vectors and reads the queries of their list in batches; it returns link counts and
edges that join what is linked, fewer than its rows, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mvspark.llm.common import checked_broadcast, connected_components, stored

THRESHOLD, SUBSPACES, CODES, ROUNDS = 0.93, 8, 256, 6
#: A list for so many vectors of the largest label; most lists; most lists of one level.
FILL, LISTS, FEW = 1024, 1 << 14, 128
SAMPLE, PER_LIST = 20_000, 12
#: Filed vectors a task holds, queries of one list that one task reads at most, and queries compared at a time.
BLOCK, QUERIES, BATCH = 1024, 1 << 15, 512
#: Share of the sample's linked pairs that probed lists must hold, how many pairs it takes to tell, and the deviations without them.
RECALL, PAIRS, SIGMAS = 0.999, 100, 4.0
#: The deviations that are tried; one step more than what the sample's pairs need is used.
STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0, np.inf)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c for each row of x, and the squared distances to all rows."""
    d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]
    return d.argmin(1), np.maximum(d, 0)


def _centroids(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = np.concatenate([nearest(x[a : a + 8192], c)[0] for a in range(0, len(x), 8192)])
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        full = count > 0
        c[full] = np.add.reduceat(x[order], start[full], axis=0) / count[full, None]
    return c


@dataclass
class Index:
    """Centroids of two levels, codebooks, and what is known of steps; its size is bounded by LISTS."""

    supers: np.ndarray
    children: list[np.ndarray]
    books: list[np.ndarray]
    edges: np.ndarray
    #: Root of the covariance of unit steps.
    spread: np.ndarray
    sigmas: float = SIGMAS

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.children)])

    def centroid(self, lists: np.ndarray) -> np.ndarray:
        return np.concatenate(self.children)[lists]

    def own(self, x: np.ndarray) -> np.ndarray:
        """The list of each unit vector."""
        top, offsets = nearest(x, self.supers)[0], self.offsets
        out = np.empty(len(x), dtype=np.int64)
        for s in np.unique(top).tolist():
            rows = np.flatnonzero(top == s)
            out[rows] = offsets[s] + nearest(x[rows], self.children[s])[0]
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of unit vectors."""
        at = self.own(x)
        rest = x - self.centroid(at)
        codes, error = np.empty((len(x), len(self.books)), dtype=np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.edges[m] : self.edges[m + 1]]
            codes[:, m] = nearest(part, book)[0]
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return at, codes, np.sqrt(error)

    def _reached(self, x: np.ndarray, c: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
        """Whether a partner of each row of x can be nearest to each row of c."""
        at, _ = nearest(x, c)
        own, norms, wide = c[at], (c**2).sum(1), c @ self.spread
        between = np.maximum(norms[at][:, None] + norms[None] - 2 * own @ c.T, 0)
        along = x @ c.T - (x * own).sum(1)[:, None]
        across = np.sqrt(np.maximum(between - along**2, 0))
        if np.isfinite(sigmas):
            across = np.minimum(across, sigmas * np.sqrt(nearest(wide, wide)[1])[at])
        reach = np.maximum(threshold * along + np.sqrt(1 - threshold**2) * across, along)
        length = np.sqrt(along**2 + across**2)
        reach = np.where((along > 0) & (along >= threshold * length), length, reach)
        return (reach + 1e-9 >= (norms[None] - norms[at][:, None]) / 2) | (np.arange(len(c))[None] == at[:, None])

    def probes(self, x: np.ndarray, threshold: float = THRESHOLD, sigmas: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All (row, list) pairs that can hold a partner: see the module's text."""
        sigmas = self.sigmas if sigmas is None else sigmas
        rows, lists, offsets = [], [], self.offsets
        top = self._reached(x, self.supers, threshold, sigmas)
        for s in np.flatnonzero(top.any(0)).tolist():
            some = np.flatnonzero(top[:, s])
            i, j = np.nonzero(self._reached(x[some], self.children[s], threshold, sigmas))
            rows.append(some[i])
            lists.append(offsets[s] + j)
        return np.concatenate(rows), np.concatenate(lists)

    def estimates(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from each row of x to each coded vector of a list."""
        rest, out = x - self.centroid(np.array([which])), np.zeros((len(x), len(codes)), dtype=np.float32)
        for m, book in enumerate(self.books):
            out += nearest(rest[:, self.edges[m] : self.edges[m + 1]], book)[1].astype(np.float32)[:, codes[:, m]]
        return np.sqrt(out)


def _linked(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a sample: of up to 8,192 rows the partner with the lowest cosine, the hardest to find."""
    left, right = [], []
    for a in range(0, min(len(x), 8192), 512):
        c = x[a : a + 512] @ x.T
        c[np.arange(len(c)), a + np.arange(len(c))] = 0
        c[(c < threshold) | (c > 1 - 1e-12)] = 2
        best = c.argmin(1)
        some = np.flatnonzero(c[np.arange(len(c)), best] < 2)
        left.append(a + some)
        right.append(best[some])
    return np.concatenate(left), np.concatenate(right)


def fit(x: np.ndarray, lists: int, threshold: float = THRESHOLD, subspaces: int = SUBSPACES) -> Index:
    """An index from a sample of unit vectors."""
    lists, dim = max(1, min(lists, len(x) // 8)), x.shape[1]
    supers = _centroids(x[:SAMPLE], lists if lists <= FEW else int(np.ceil(lists**0.5)))
    children = [c[None] for c in supers]
    if lists > FEW:
        top = np.concatenate([nearest(x[a : a + 8192], supers)[0] for a in range(0, len(x), 8192)])
        own = [x[top == s] for s in range(len(supers))]
        children = [_centroids(o, max(1, round(lists * len(o) / len(x)))) if len(o) else c[None] for o, c in zip(own, supers)]
    edges = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
    index = Index(supers, children, [], edges, np.eye(dim) / np.sqrt(dim))
    part = x[:SAMPLE]
    rest = part - index.centroid(index.own(part))
    index.books = [_centroids(rest[:, a:b], min(CODES, max(1, len(part) // 8))) for a, b in zip(edges[:-1], edges[1:])]

    i, j = _linked(part, threshold)
    if len(i) >= PAIRS:
        t = (part[i] * part[j]).sum(1, keepdims=True)
        u = part[j] - t * part[i]
        u /= np.maximum(np.sqrt((u**2).sum(1, keepdims=True)), 1e-12)
        cov = u.T @ u / len(u) + np.eye(dim) * 0.01 / dim
        values, vectors = np.linalg.eigh(cov)
        index.spread = vectors * np.sqrt(values)
        at = index.own(part)
        low, high = np.where(at[i] <= at[j], i, j), np.where(at[i] <= at[j], j, i)
        for sigmas, more in zip(STEPS, STEPS[1:]):
            rows, found = index.probes(part[low], threshold, sigmas)
            index.sigmas = more
            if len(np.unique(rows[found == at[high][rows]])) >= RECALL * len(low):
                break
    return index


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1), 1e-300)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


class _Block:
    """Filed vectors of one list against the batches of its queries."""

    def __init__(self, index: Index, threshold: float, which: int, dim: int, pdf: pd.DataFrame, kind: np.dtype) -> None:
        self.index, self.threshold, self.which, self.dim, self.kind = index, threshold, which, dim, kind
        self.y = self.vectors(pdf)
        self.node, self.size, self.err = pdf["node"].to_numpy(), pdf["size"].to_numpy(), pdf["err"].to_numpy()
        self.codes = np.frombuffer(b"".join(pdf["codes"]), dtype=np.uint8).reshape(len(pdf), -1)
        self.n, self.root = np.zeros(len(pdf), dtype=np.int64), self.node.copy()

    def vectors(self, pdf: pd.DataFrame) -> np.ndarray:
        return unit(np.frombuffer(b"".join(pdf["v"]), dtype=self.kind).reshape(len(pdf), self.dim))

    def ask(self, pdf: pd.DataFrame) -> list[np.ndarray]:
        """Rows (node, n, root): links of the queries and what they join."""
        x, node, size, cross = self.vectors(pdf), pdf["node"].to_numpy(), pdf["size"].to_numpy(), pdf["cross"].to_numpy(bool)
        near = np.ones((len(x), len(self.y)), dtype=bool)
        if self.codes.shape[1]:
            reach = np.sqrt(2 - 2 * self.threshold) + 1e-4  # the tables have single precision
            near = self.index.estimates(x, self.which, self.codes) <= reach + self.err[None]
        i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(i):
            return []
        hit = near[np.ix_(i, j)] & (x[i] @ self.y[j].T >= self.threshold) & (node[i][:, None] != self.node[j][None])
        if not hit.any():
            return []
        n = hit @ self.size[j]
        self.n[j] += (size[i] * cross[i]) @ hit
        ask, old = node[i].copy(), self.root[j].copy()
        item, last = old.copy(), np.iinfo(np.int64).max
        while True:  # the smallest node that is joined
            new = np.minimum(ask, np.where(hit, item[None], last).min(1))
            back = np.minimum(item, np.where(hit, new[:, None], last).min(0))
            if (new == ask).all() and (back == item).all():
                break
            ask, item = new, back
        self.root[j] = item
        moved = np.unique(np.stack([old, item], 1)[old != item], axis=0)
        some = n > 0
        return [np.stack([node[i][some], n[some], ask[some]], 1), np.stack([moved[:, 0], np.zeros(len(moved), dtype=np.int64), moved[:, 1]], 1)]

    def end(self) -> list[np.ndarray]:
        some = (self.n > 0) | (self.root != self.node)
        return [np.stack([self.node[some], self.n[some], self.root[some]], 1)]


def _compare(index, threshold: float, kind: np.dtype):
    """Batches sorted by (la, lb, dim, list, bi, bq, asks): filed vectors come before their queries."""
    keys = ["la", "lb", "dim", "list", "bi", "bq", "asks"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, items, block = None, [], None

        def rows(found: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame(np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64), columns=["node", "n", "root"])

        for pdf in batches:
            key = pdf[keys].to_numpy(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)]):
                if a == b:
                    continue
                of, asks, part = tuple(key[a, :6]), key[a, 6], pdf.iloc[a:b]
                if of != group:
                    found += block.end() if block else []
                    group, items, block = of, [], None
                if not asks:
                    items.append(part)
                    continue
                if block is None:
                    if not items:
                        continue
                    block = _Block(index.value, threshold, int(of[3]), int(of[2]), pd.concat(items, ignore_index=True), kind)
                    items = []
                for at in range(0, len(part), BATCH):
                    found += block.ask(part.iloc[at : at + BATCH])
            yield rows(found)
        if block:
            yield rows(block.end())

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine is at least the threshold.
    A vector that is null, empty, zero or holds a null or a non-finite component links with nothing,
    nor does one whose label is null, nor vectors of different lengths: each is its own component.
    Rows that repeat a vector are links of one another, whatever their ids; the smallest id of all
    rows reached is the component. A null id is no smallest id unless nothing else is reached. Only
    the most frequent length of vectors has more than one list; others are compared in blocks.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"  # floats are widened where they are compared
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda e: F.coalesce((F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False))) & F.exists("v", lambda e: e != 0)
    valid = F.coalesce(finite & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("h1", F.when(valid, F.xxhash64("label", "v"))).withColumn("h2", F.when(valid, F.xxhash64(F.lit("b"), "v", "label")))
    keys = ["h1", "h2"]
    classes = rows.where("h1 is not null").groupBy(*keys).agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("size"))
    label = [F.xxhash64("label").alias("la"), F.xxhash64(F.lit("b"), "label").alias("lb")]
    classes = stored(classes.select("*", *label, F.size("v").alias("dim")).drop("label").withColumn("node", F.monotonically_increasing_id()), "classes")

    largest = classes.groupBy("dim", "la", "lb").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    main = largest.orderBy(F.desc("n"), "dim").first()  # of one row a vector length the first
    if main is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    lists = max(1, min(LISTS, main["most"] // FILL))
    sample = classes.where(F.col("dim") == main["dim"]).select("v", *keys).orderBy(*keys).limit(max(SAMPLE, PER_LIST * lists)).select("v").toArrow()["v"].combine_chunks()
    index = fit(unit(sample.flatten().to_numpy().reshape(-1, main["dim"])), lists, threshold)
    found = stored(_links(classes, classes.sparkSession.sparkContext.broadcast(index), main["dim"], threshold, block, np.dtype("<f4" if single else "<f8")), "links")

    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = classes.select(*keys, "node", "low", "size").join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    comp = comp.join(lows, "root").join(counts, "node", "left")
    comp = comp.select(*keys, "component_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("id", *keys).join(comp, keys, "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _links(classes: DataFrame, index, main: int, threshold: float, block: int, kind: np.dtype) -> DataFrame:
    """Rows (node, n, root): links counted by node and task, and edges that join what is linked."""

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024].reset_index(drop=True)
                own, probed = np.zeros(len(part), dtype=np.int32), np.full(len(part), None, dtype=object)
                codes, err = np.full(len(part), b"", dtype=object), np.full(len(part), np.inf)
                packed = [np.asarray(v, dtype=kind).tobytes() for v in part["v"]]
                some = np.flatnonzero(part["dim"].to_numpy() == main)
                if len(some):
                    x = unit(np.frombuffer(b"".join(packed[k] for k in some), dtype=kind).reshape(len(some), main))
                    at, c, e = index.value.encode(x)
                    own[some], err[some] = at, e
                    codes[some] = [k.tobytes() for k in c]
                    rows, lists = index.value.probes(x, threshold)
                    use = lists >= at[rows]
                    order = np.argsort(rows[use], kind="stable")
                    parts = np.split(lists[use][order].astype(np.int32), np.cumsum(np.bincount(rows[use], minlength=len(some)))[:-1])
                    for k, p in zip(some.tolist(), parts):
                        probed[k] = p
                for k in np.flatnonzero([p is None for p in probed]).tolist():
                    probed[k] = np.zeros(1, dtype=np.int32)
                yield part[["node", "la", "lb", "dim", "size"]].assign(list=own, probed=probed, codes=codes, err=err, v=packed)

    cell = ["la", "lb", "dim", "list"]
    filed = classes.select("node", "la", "lb", "dim", "size", "v").mapInPandas(file, "node long, la long, lb long, dim int, size long, list int, probed array<int>, codes binary, err double, v binary")
    filed = stored(filed, "filed")
    items = filed.select("node", *cell, "size", "codes", "err", "v", F.lit(False).alias("cross"), F.lit(0).alias("asks"))
    asks = filed.withColumnRenamed("list", "own").withColumn("list", F.explode("probed"))
    asks = asks.select("node", *cell, "size", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("err"), "v", (F.col("list") != F.col("own")).alias("cross"), F.lit(1).alias("asks"))
    parts = lambda df, size, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # a row for each list and label: broadcast if they are few, so that vectors are shuffled once only
    sizes = checked_broadcast(stored(parts(items, block, "mi").join(parts(asks, QUERIES, "mq"), cell), "lists"))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    part_of = lambda m: F.pmod(F.xxhash64("node"), F.col(m)).cast("int")
    items = items.join(sizes, cell).withColumn("bi", part_of("mi")).withColumn("bq", spread("mq"))
    asks = asks.join(sizes, cell).withColumn("bq", part_of("mq")).withColumn("bi", spread("mi"))
    both = items.unionByName(asks).select("node", *cell, "bi", "bq", "asks", "cross", "size", "codes", "err", "v")
    both = both.repartition(*cell, "bi", "bq").sortWithinPartitions(*cell, "bi", "bq", "asks")
    return both.mapInPandas(_compare(index, threshold, kind), "node long, n long, root long")
