"""Language identification by string kernels.

The blended-spectrum kernel counts the distinct character n-grams (n = 1, 2, 3) that two texts
share, scaled by the root of both texts' own counts. An n-gram is a run of code points, lower-cased,
told apart by a hash of 18 bits; a run of anything but letters counts as one. A sample of landmark
texts, in an order of hashed ids, gives the Nyström map of that kernel; one-versus-rest kernel ridge
regression is solved in the mapped space, and a batch of texts is scored with two matrix products.
Every language with a labelled row is learned; landmarks and weights are as many as landmarks or
languages, whichever are more.

A null text and one without a letter get `und` with score 0; repeated rows and ties score alike
(ties take the first language by code point); an empty table gives an empty result; without any
learnable row every text is `und`. Columns beside `text` pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unspool.llm import kernels as K
from unspool.llm.common import held_out

#: Bits of an n-gram's hash.
_BITS = 18
_GRAMS = 1 << _BITS
#: The lower-cased letter of each code point of the first planes' part, 0 for what is no letter.
_LETTER = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x3000)], np.uint64)
#: Odd factors for the places of an n-gram, and what tells lengths apart.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Landmarks have as many n-grams at least, where there are such texts.
_LEAST_GRAMS = 40


def grams(text: str | None) -> np.ndarray:
    """The sorted distinct n-grams of a text, as numbers; a run of other characters counts as one."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    near = points < len(_LETTER)
    c = np.where(near, _LETTER[np.where(near, points, 0)], np.uint64(0))
    if not near.all():
        far, back = np.unique(points[~near], return_inverse=True)
        c[~near] = np.array([ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in far.tolist()], np.uint64)[back]
    if not c.any():
        return np.zeros(0, np.int64)
    none = np.zeros(1, np.uint64)
    c = np.concatenate((none, c, none))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    seen = np.zeros(_GRAMS, bool)
    run = np.zeros(len(c), np.uint64)
    for n in range(3):
        run = run[: len(c) - n] + (c[n:] + np.uint64(1)) * _PLACE[n]
        seen[(K.mix(run + np.uint64(n)) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class KernelRidge:
    """place: for each n-gram its column among the landmarks' n-grams, or -1; landmarks and weights by column."""

    langs: list[str]
    place: np.ndarray
    landmarks: np.ndarray
    landmark_norm: np.ndarray
    weights: np.ndarray

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), self.landmarks.shape[1]), np.float32)
        for i, g in enumerate(rows):
            at = self.place[g]
            x[i, at[at >= 0]] = 1
        norm = np.sqrt(np.maximum([len(g) for g in rows], 1))
        return (x @ self.landmarks.T) / (norm[:, None] * self.landmark_norm)

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], np.ndarray]:
        best, score = [], np.zeros(len(texts))
        for a in range(0, len(texts), batch):
            rows = [grams(t) for t in texts[a : a + batch]]
            if not self.langs:
                best += ["und"] * len(rows)
                continue
            value = self.kernel(rows) @ self.weights
            top = value.argmax(1)
            share = np.exp(8 * (value - value.max(1, keepdims=True)))
            share = share[np.arange(len(rows)), top] / share.sum(1)
            for i, g in enumerate(rows):
                best.append(self.langs[top[i]] if len(g) else "und")
                score[a + i] = share[i] if len(g) else 0.0
        return best, score


def fit_texts(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-3) -> KernelRidge:
    """Fit on texts in an order that tells nothing of them: the landmarks are the first of each language."""
    names = sorted(set(langs))
    sets = [grams(t) for t in texts]
    use = [i for i, g in enumerate(sets) if len(g)]
    if not use:
        return KernelRidge([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    # The landmarks: as many of each language, in the given order, very short texts only where there are no others.
    marks: list[int] = []
    for name in names:
        own = [i for i in use if langs[i] == name]
        marks += sorted(own, key=lambda i: len(sets[i]) < _LEAST_GRAMS)[: max(1, landmarks // len(names))]
    place = np.full(_GRAMS, -1, np.int64)
    known = np.unique(np.concatenate([sets[i] for i in marks]))
    place[known] = np.arange(len(known))
    model = KernelRidge(names, place, np.zeros((len(marks), len(known)), np.float32), np.sqrt([len(sets[i]) for i in marks]), np.zeros((0, 0)))
    for k, i in enumerate(marks):
        model.landmarks[k, place[sets[i]]] = 1
    values, vectors = np.linalg.eigh(model.kernel([sets[i] for i in marks]).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    y = np.where(np.array([langs[i] for i in use])[:, None] == np.array(names), 1.0, -1.0)
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names)))
    for a in range(0, len(use), 256):
        phi = model.kernel([sets[i] for i in use[a : a + 256]]) @ root
        gram += phi.T @ phi
        right += phi.T @ y[a : a + 256]
    model.weights = root @ np.linalg.solve(gram + ridge * len(use) * np.eye(len(gram)), right)
    return model


def fit(docs: DataFrame, fit_rows: int = 3_000, landmarks: int = 256) -> KernelRidge:
    """Fit on at most fit_rows documents with a language, outside the held-out quarter, as many of each language and one at least."""
    own = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # One row for each language reaches the driver.
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return fit_texts([], [])
    # One pass thins every language by hashed ids to a little more than its part, which is then cut.
    each = max(1, fit_rows // len(counts))
    key = F.xxhash64(F.lit(20), F.col("doc_id"))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, (2 * each + 100) / n)))])
    ids = own.where(F.pmod(key, F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)).withColumn("key", key)
    ids = ids.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))).where(F.col("place") <= each).drop("place")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").toPandas()
    rows = rows.sort_values(["key", "doc_id", "text"])
    return fit_texts(rows["text"].tolist(), rows["lang"].tolist(), landmarks)


def predict(model: KernelRidge, text: Column | str) -> Column:
    """struct(lang_pred, score) of each text."""

    @F.arrow_udf("lang_pred string, score double")
    def language(text: pa.Array) -> pa.Array:
        best, score = model.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return language(text)
