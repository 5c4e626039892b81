"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and shrunken covariance; the score comes from the difference of the
two Mahalanobis log densities, taken with Cholesky factors that are computed once per fit.

Defined results: a null, empty or blank text has the statistics of a text without words and gets a
score like any other; repeated rows and ties score alike; an empty table gives an empty result;
where only one class is labelled the score is that class's share of the labels; columns that docs
has beside `text` pass through, and one named as the new column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unspool.llm import kernels as K
from unspool.llm.common import fit_sample, held_out

#: Classes of bytes that the statistics count.
_CLASSES = ("space", "newline", "lower", "upper", "digit", "stop", "symbol", "beyond")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.int64)
_CLASS[[9, 11, 12, 32]] = _CLASSES.index("space")
_CLASS[[10, 13]] = _CLASSES.index("newline")
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = (_CLASSES.index(x) for x in ("lower", "upper", "digit"))
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _CLASSES.index("stop")
_CLASS[128:] = _CLASSES.index("beyond")

FEATURES = ("log_words", "word_length", "upper_share", "symbol_share", "digit_share", "stops_a_word", "repeats", "distinct", "symbol_ends", "lone_symbols", "lines_a_word", "letters_share")


def statistics(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offs = K.buffer_of(col)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for a, b in K.steps(offs):
        out[a:b] = _statistics(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
    return out


def _statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    size = np.diff(offs)
    kinds = np.bincount(np.repeat(np.arange(n), size) * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    count = dict(zip(_CLASSES, kinds.T.astype(float), strict=True))
    begin, end, row = K.words(data, offs)
    hashes = K.word_hashes(data, begin, end)
    words = np.bincount(row, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    visible = np.maximum(size - count["space"] - count["newline"], 1)
    letters = count["lower"] + count["upper"] + count["beyond"]
    again = np.zeros(n)
    distinct = np.zeros(n)
    ends = lone = again
    if len(row):
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[1:][same], minlength=n)
        order = np.lexsort((hashes, row))
        new = np.ones(len(row), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=n)
        symbol = _CLASS[data[end - 1]] == _CLASSES.index("symbol")
        ends = np.bincount(row[symbol], minlength=n)
        lone = np.bincount(row[symbol & (end - begin == 1)], minlength=n)
    return np.column_stack([
        np.log1p(words),
        np.log1p(visible / per_word),
        np.sqrt(count["upper"] / np.maximum(letters, 1)),
        np.sqrt(count["symbol"] / visible),
        np.sqrt(count["digit"] / visible),
        np.sqrt(count["stop"] / per_word),
        np.sqrt(again / per_word),
        np.log1p(distinct) / np.log1p(per_word),
        np.sqrt(ends / per_word),
        np.sqrt(lone / per_word),
        np.sqrt(count["newline"] / per_word),
        letters / visible,
    ])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of classes 0 and 1; calibration of the log ratio."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    slope: float
    bias: float
    prior: float | None = None

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = [((x - self.mean[c]) @ self.whiten[c].T) for c in (0, 1)]
        return 0.5 * ((z[0] ** 2).sum(1) + self.log_det[0] - (z[1] ** 2).sum(1) - self.log_det[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.log_ratio(x)) + self.bias, -30, 30)))


def fit_arrays(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> Discriminant:
    """Fit on statistics x and 0/1 labels y. shrink: the pooled diagonal's share of each covariance."""
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0, 0, float(y.mean()) if len(y) else 0.5)
    pooled = np.diag(x.var(0) + 1e-4)
    mean, whiten, log_det = [], [], []
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T, bias=True) if len(own) > 1 else np.zeros((d, d))
        factor = np.linalg.cholesky((1 - shrink) * cov + shrink * pooled)
        mean.append(own.mean(0))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    model = Discriminant(np.array(mean), np.array(whiten), np.array(log_det), 1, 0)
    model.slope, model.bias = _calibrate(np.arcsinh(model.log_ratio(x)), y)
    return model


def _calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic fit of y on z by Newton steps with a small ridge."""
    a, w = np.column_stack([z, np.ones(len(z))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0)), float(w[1])


def statistics_udf():
    @F.arrow_udf("array<double>")
    def doc_statistics(text: pa.Array) -> pa.Array:
        x = statistics(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return doc_statistics


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 20_000) -> Discriminant:
    """Fit on at most fit_rows labelled rows outside the held-out quarter; only their statistics reach the driver."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = fit_sample(own.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(statistics_udf()("text").alias("x"), "label").toPandas()
    if not len(rows):
        return fit_arrays(np.zeros((0, len(FEATURES))), np.zeros(0, int))
    return fit_arrays(np.stack(rows["x"].to_list()), rows["label"].to_numpy())


def score(model: Discriminant, text: Column | str) -> Column:
    """The probability of label 1 for each text."""

    @F.arrow_udf("double")
    def quality_score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(text)))

    return quality_score(text)
