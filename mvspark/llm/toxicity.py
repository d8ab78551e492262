"""Toxicity by a factorisation machine over hashed terms.

Terms are the distinct lower-case words of a text and the stems (first letters, see STEMS) of
longer ones, hashed to BUCKETS. The machine adds a weight for each term and, for each pair of
terms, the product of their factors, so that a pair (an insult and the mention of a group) can
count for more than its parts, and a word that says nothing alone can take another one back.

Every term that MIN_TEXTS texts of the sample hold takes part; labels choose none of them. Weights
and factors of either sign are learnt by gradient steps that shrink them (SHRINK), so that those
of terms that tell nothing, alone or in a pair, end at zero and are left out of the machine.

A fifth of the sample is kept from the fit and calibrates the scores: a logistic curve over the
machine's output (Platt), so that a score is the chance of the label.

Training uses a bounded sample: at most SAMPLE labelled texts, in the order of a hash of id and
text, of which only hashed terms reach the driver. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mvspark.llm.common import held_out, stored, text_batches, train_row

SAMPLE, BUCKETS, STEMS, FACTORS = 12_000, 1 << 18, (4, 5), 4
#: In how many training texts a term must occur.
MIN_TEXTS = 3
#: Pull of the calibration to the machine's own output, which counts where few rows are held back.
PULL = 0.1
#: Passes over the sample; after the first WARM of them terms at zero leave.
EPOCHS, WARM, BATCH, SEED = 20, 3, 256, 7
#: Step of the bias, the weights and of the factors, shrinking of either, decay of both, spread of the factors at the start.
BIAS_RATE, RATE, FACTOR_RATE, SHRINK, FACTOR_SHRINK, DECAY, SPREAD = 1.0, 0.1, 0.015, 0.02, 0.4, 1e-4, 0.02
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[int, ...]:
    """Buckets of one lower-case word: the word and its stems, where it is longer than they are."""
    return (zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(b"^" + word[:n].encode()) % BUCKETS for n in STEMS if len(word) > n))


def terms(text: str | None) -> np.ndarray:
    found = {b for w in set(_WORD.findall((text or "").lower())) for b in word_terms(w)}
    return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class Machine:
    """Bias, and slot, weight and factors of each kept term."""

    bias: float
    kept: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scorer(self):
        """A function from a text to its score. Words that hold no kept term cost one look-up."""
        slot = {b: k for k, b in enumerate(self.kept.tolist())}
        memo: dict[str, tuple[int, ...]] = {}

        def slots(word: str) -> tuple[int, ...]:
            if len(memo) > 200_000:
                memo.clear()
            memo[word] = got = tuple(slot[b] for b in word_terms(word) if b in slot)
            return got

        def score(text: str | None) -> float:
            at: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                got = memo.get(word)
                if got is None:
                    got = slots(word)
                if got:
                    at.update(got)
            z = self.bias
            if at:
                rows = np.fromiter(sorted(at), dtype=np.int64, count=len(at))
                v = self.factors[rows]
                z += self.weights[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def _outputs(machine: Machine, rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(rows))
    for k, r in enumerate(rows):
        at = np.searchsorted(machine.kept, r)
        at = at[(at < len(machine.kept)) & (machine.kept[np.minimum(at, max(0, len(machine.kept) - 1))] == r)] if len(machine.kept) else at[:0]
        v = machine.factors[at]
        out[k] = machine.bias + machine.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
    return out


def calibrated(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """A machine fitted to four fifths of the rows, its slope and offset to the rest."""
    rest = np.arange(len(rows)) % 5 == 4
    machine = fit([r for r, k in zip(rows, rest) if not k], labels[~rest])
    n1 = labels[rest].sum()
    if not len(machine.kept) or n1 in (0, rest.sum()):
        return machine
    z, y = np.clip(_outputs(machine, [r for r, k in zip(rows, rest) if k]), -30, 30), labels[rest].astype(float)
    y = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (rest.sum() - n1 + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        g = x.T @ (p - y) + PULL * (theta - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(2)
        theta = theta - np.linalg.solve(h, g)
    a, b = max(float(theta[0]), 1e-3), float(theta[1])
    return Machine(a * machine.bias + b, machine.kept, a * machine.weights, a**0.5 * machine.factors)


def _batch(at: np.ndarray, start: np.ndarray, docs: np.ndarray, alive: np.ndarray | None) -> tuple:
    """One batch of the sample: documents, terms by document, the document of each, their order by term, and the distinct terms."""
    term = np.concatenate([at[start[d] : start[d + 1]] for d in docs])
    local = np.repeat(np.arange(len(docs), dtype=np.int16), start[docs + 1] - start[docs])
    if alive is not None:
        use = alive[term]
        term, local = term[use], local[use]
    by_term = np.argsort(term, kind="stable").astype(np.int32)
    ordered = term[by_term]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return docs, term, local, by_term, first, ordered[first]


def _summed(values: np.ndarray, local: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by document; local is ascending."""
    out = np.zeros((n, *values.shape[1:]))
    if len(local):
        first = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        out[local[first]] = np.add.reduceat(values, first, axis=0)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """A machine from term buckets of each text and its label 0 or 1; without both labels it scores 0 or 1 throughout."""
    labels = np.asarray(labels, dtype=float)
    if not len(rows) or labels.min() == labels.max():
        only = -9.0 if not len(rows) or labels.max() == 0 else 9.0
        return Machine(only, np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    n, n1 = len(rows), labels.sum()
    # of a sample of some million terms arrays are kept narrow and few, as this runs on the driver
    flat = np.concatenate(rows)
    kept = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= MIN_TEXTS)
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[kept] = np.arange(len(kept))
    at = slot[flat]
    del flat
    ends = np.cumsum([0, *(len(r) for r in rows)]).tolist()
    start = np.cumsum([0, *(np.count_nonzero(at[a:b] >= 0) for a, b in zip(ends, ends[1:]))])
    at = at[at >= 0]

    rng = np.random.default_rng(SEED)
    w, v = np.zeros(len(kept), dtype=np.float32), rng.normal(0, SPREAD, (len(kept), FACTORS)).astype(np.float32)
    bias, gw, gv, gb = np.log(n1 / (n - n1)), np.full_like(w, 1e-4), np.full_like(v, 1e-4), 1e-6
    balance = np.where(labels == 1, (n - n1) / n1, 1.0) ** 0.5
    order = rng.permutation(n)
    parts = [order[a : a + BATCH] for a in range(0, n, BATCH)]
    batches: list[tuple] = []
    for epoch in range(EPOCHS):
        if epoch == WARM:
            alive = (w != 0) | (v != 0).any(1)
            batches = [_batch(at, start, docs, alive) for docs in parts]
        for k in rng.permutation(len(parts)):
            docs, term, local, by_term, first, some = batches[k] if batches else _batch(at, start, parts[k], None)
            vt = v[term]
            sums = _summed(vt, local, len(docs))
            z = bias + _summed(w[term], local, len(docs)) + 0.5 * ((sums**2).sum(1) - _summed((vt**2).sum(1), local, len(docs)))
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[docs]) * balance[docs] / len(docs)
            gb += g.sum() ** 2
            bias -= BIAS_RATE * g.sum() / np.sqrt(gb)
            if not len(some):
                continue
            gl = g.astype(np.float32)[local]
            dw = np.add.reduceat(gl[by_term], first) + DECAY / len(parts) * w[some]
            dv = np.add.reduceat((gl[:, None] * (sums.astype(np.float32)[local] - vt))[by_term], first, axis=0) + DECAY / len(parts) * v[some]
            gw[some] += dw**2
            gv[some] += dv**2
            step = RATE / np.sqrt(gw[some])
            moved = w[some] - step * dw
            w[some] = np.sign(moved) * np.maximum(np.abs(moved) - step * SHRINK / len(parts), 0)
            moved = v[some] - FACTOR_RATE / np.sqrt(gv[some]) * dv
            short = FACTOR_RATE / np.sqrt(gv[some].mean(1)) * FACTOR_SHRINK / len(parts)
            v[some] = moved * np.maximum(1 - short / np.maximum(np.sqrt((moved**2).sum(1)), 1e-12), 0)[:, None]
    counts = (w != 0) | (v != 0).any(1)
    return Machine(float(bias), kept[counts].astype(np.int32), w[counts].astype(float), v[counts].astype(float))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fits a machine to at most `sample` labelled training texts (see common.train_row).

    Of several labels of an id the highest counts; null ids and null labels are none. Rows that repeat
    an id and its text count once; null texts are empty ones. Without labelled rows, or with one label
    only, the machine gives every text the same score.
    """
    text_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train_row(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    near = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # two looks at the texts: the first brings keys only, so that an id with any number of rows stays bounded
    keys = rows.select("id", F.xxhash64("text").alias("th")).join(F.broadcast(near), "id").distinct()
    picked = stored(keys.orderBy(F.xxhash64("id", "th"), "id", "th").limit(sample), "labelled")
    rows = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(picked), ["id", "th"])  # sample rows of three numbers
    rows = rows.groupBy("id", "th", "y").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"], "t": [np.sort(terms(t)) for t in pdf["text"]]})

    got = rows.select(F.xxhash64("id", "th").alias("h"), "y", "text").mapInPandas(run, "h long, y int, t array<int>").toArrow()
    parts = []
    for batch in got.to_batches():  # texts are views of what was received, never copied
        lists = batch.column("t")
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        parts += [(h, y, flat[a:b]) for h, y, a, b in zip(batch.column("h").to_pylist(), batch.column("y").to_pylist(), ends[:-1].tolist(), ends[1:].tolist())]
    parts.sort(key=lambda p: p[0])
    return calibrated([t for _, _, t in parts], np.array([y for _, y, _ in parts], dtype=np.int64))


def _by_text(docs: DataFrame, machine: Machine):
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most BUCKETS terms, of which few are not at zero

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield pd.Series([one(t if isinstance(t, str) else None) for t in texts], dtype=float)

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1), predicted (1 from THRESHOLD).

    A null or wordless text gets the score of the bias alone. Repeated rows and null ids (never held
    out) stay; an empty table gives an empty result. Only the text is an input of a score.
    """
    out = docs.select(F.col(id_col).alias("id"), _by_text(docs, machine)(F.col(text_col)).alias("score"))
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score less than THRESHOLD.

    Null and wordless texts score the bias alone; repeated rows and null ids stay or go with their
    text; an empty table gives an empty one.
    """
    return docs.where(_by_text(docs, machine)(F.col(text_col)) < THRESHOLD)
