"""Toxicity: a factorization machine over hashed terms.

Beside a weight for each term it learns a short vector for each, whose inner products weigh pairs
of terms that occur together (an insult with a group mention), which no sum of weights can tell
from the same words apart. A document's terms are its distinct lower-cased letter runs and their
beginnings (four and five code points, for inflected forms), hashed into 2**bits buckets.

A null, empty or letterless text has no terms and scores the bias; repeated rows and ties score
alike; an empty table gives an empty result; without labels of both kinds the score is the labels'
mean (0 without any). Columns beside `text` pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unspool.llm import kernels as K
from unspool.llm.common import fit_sample, held_out

BITS = 20
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Hits that a step of the fit holds at once.
_STEP_HITS = 1 << 19
#: Lengths in code points of the beginnings of a word that are terms; 0 is the whole word.
PREFIXES = (0, 4, 5)


def terms(col: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each step of rows: the first row, the row of each distinct term within the step, the term."""
    data, offs = K.buffer_of(col)
    for a, b in K.steps(offs):
        part = K.lower_latin(data[offs[a] : offs[b]])
        row, h = K.letter_terms(part, offs[a : b + 1] - offs[a], _NOT_LETTER, PREFIXES, tuple(np.uint64(0x51 + k) for k in PREFIXES))
        key = np.unique((row.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)))
        yield a, (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Machine:
    """bias, and for each kept term (sorted) its weight and its vector."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def known(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        return row[hit], at[hit]

    def raw(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """row: ascending rows of the hits; at: places of their terms."""
        linear = np.bincount(row, self.weight[at], n)
        v = self.vector[at]
        total = np.column_stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])]) if v.shape[1] else np.zeros((n, 0))
        return self.bias + linear + 0.5 * ((total**2).sum(1) - np.bincount(row, (v**2).sum(1), n))

    def score(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        sizes = []
        for a, row, term in terms(col):
            sizes.append((a, *self.known(row, term)))
        for (a, row, at), b in zip(sizes, [*[s[0] for s in sizes[1:]], len(col)], strict=True):
            out[a:b] = self.raw(row, at, b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_arrays(row: np.ndarray, term: np.ndarray, y: np.ndarray, factors: int = 8, rounds: int = 200, rate: float = 0.05, ridge: float = 3e-5) -> Machine:
    """Adam on the logistic loss over all rows at once; (row, term) are the distinct hits, rows ascending."""
    kept = np.unique(term)
    share = float(y.mean()) if len(y) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    rng = np.random.Generator(np.random.PCG64(11))
    m = Machine(kept, bias, np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), factors)))
    if len(set(y.tolist())) < 2 or not len(kept):
        m.weight[:], m.vector[:] = 0, 0
        return m
    at, n = np.searchsorted(kept, term), len(y)
    params = [np.array([m.bias]), m.weight, m.vector]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # Sums are made over some rows at a time, so that memory doesn't follow the hits.
    ends = np.searchsorted(row, np.arange(n + 1))
    steps = [0, *(int(i) for i in np.flatnonzero(np.diff(ends // _STEP_HITS)) + 1 if 0 < i < n), n]
    for t in range(1, rounds + 1):
        gb, gw, gv = 0.0, ridge * m.weight, ridge * m.vector
        for r0, r1 in itertools.pairwise(steps):
            part = slice(ends[r0], ends[r1])
            own, of, size = row[part] - r0, at[part], r1 - r0
            v = m.vector[of]
            total = np.column_stack([np.bincount(own, v[:, f], size) for f in range(factors)])
            raw = params[0][0] + np.bincount(own, m.weight[of], size) + 0.5 * ((total**2).sum(1) - np.bincount(own, (v**2).sum(1), size))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[r0:r1]) / n
            pull = g[own, None] * (total[own] - v)
            gb += g.sum()
            gw = gw + np.bincount(of, g[own], len(kept))
            gv = gv + np.column_stack([np.bincount(of, pull[:, f], len(kept)) for f in range(factors)])
        for k, grad in enumerate((np.array([gb]), gw, gv)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            params[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-10)
    m.bias = float(params[0][0])
    return m


def select_terms(term: np.ndarray, seen: np.ndarray, marked: np.ndarray, rows: int, positives: int, keep: int | None = 2048, least: int = 5, gain: float = 6.6) -> np.ndarray:
    """The terms, seen in `least` rows or more, whose rows' labels differ from chance by a chi-square over `gain`; at most the `keep` best, or all."""
    share = positives / max(rows, 1)
    gains = np.where(seen >= least, (marked - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9), -1.0)
    best = np.lexsort((term, -gains))[:keep]
    return np.sort(term[best[gains[best] >= gain]])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = 20_000, keep: int | None = 2048, least: int = 5, gain: float = 6.6) -> Machine:
    """Fit on at most fit_rows labelled rows outside the held-out quarter.

    The machine sees the terms of at least `least` fitted rows whose rows' labels differ from chance
    by a chi-square of `gain`, at most `keep` of them. A pair of words that tell nothing each by
    itself is learned with gain=0 and keep=None, which leaves all terms in; that takes time in
    proportion to all words of the fitted rows.
    The counts of terms are made where the rows are; the driver gets the counts of terms that `least`
    rows or more hold, at most 2**BITS of them, then the hits of the kept terms.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = fit_sample(own.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marked, n, hits = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0, 0
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            n, hits = n + len(y), hits + int(y.sum())
            for a, row, term in terms(batch.column(0)):
                seen += np.bincount(term, minlength=1 << BITS)
                marked += np.bincount(term, y[a + row], 1 << BITS).astype(np.int64)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n)), pa.array(np.append(marked[at], hits))], ["term", "seen", "marked"])

    counts = rows.mapInArrow(count, "term long, seen long, marked long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("marked").alias("marked")).where((F.col("term") < 0) | (F.col("seen") >= least)).toPandas()
    total = counts[counts["term"] < 0]
    n, hits = (int(total["seen"].iloc[0]), int(total["marked"].iloc[0])) if len(total) else (0, 0)
    counts = counts[counts["term"] >= 0]
    kept = select_terms(counts["term"].to_numpy(), counts["seen"].to_numpy(), counts["marked"].to_numpy(), n, hits, keep, least, gain)
    only = Machine(kept, 0.0, np.zeros(len(kept)), np.zeros((len(kept), 0)))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            start = 0
            ends = []
            for _, row, term in terms(batch.column(0)):
                ends.append((row, term))
            data, offs = K.buffer_of(batch.column(0))
            for (a, b), (row, term) in zip(K.steps(offs), ends, strict=True):
                row, at = only.known(row, term)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                found += [kept[at[cut[i] : cut[i + 1]]] for i in range(b - a)]
                start = b
            assert start == batch.num_rows
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))), batch.column(1)], ["terms", "label"])

    hitsdf = rows.mapInArrow(sift, "terms array<long>, label int").toPandas()
    lists = [np.asarray(x, np.int64) for x in hitsdf["terms"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fit_arrays(row, np.concatenate(lists) if lists else np.zeros(0, np.int64), hitsdf["label"].to_numpy().astype(float))


def score(model: Machine, text: Column | str) -> Column:
    """The probability that a text is toxic."""

    @F.arrow_udf("double")
    def toxicity_score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return toxicity_score(text)
