"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, pairs of neighbours and pairs with one word
between; each counts once. Every coordinate has its own learning rate, and L1 leaves few weights
that are not zero; those are what is broadcast. Last, the bias moves the margin with the best F1 on the
training rows to a score of 0.5.

Training takes at most `max_rows` labelled rows, those with the smallest hash of the id (a
documented bound; every row is scored). Cases: without labelled rows of both kinds the score is
the smoothed share of label 1 (0.5 without any); a null or empty text scores by the bias alone; of
several labels of one id the largest holds; null labels are left out; repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import ALNUM, U, Words, map_docs, mix, utf8_parts

BITS = 20
MAX_ROWS = 6000


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their documents (not yet distinct)."""
    h, d, low = words.h, words.d, U((1 << bits) - 1)
    parts, docs = [mix(h ^ U(11)) & low], [d]
    for gap, salt in ((1, 0x9E6C63D0876A9A35), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            good = d[gap:] == d[:-gap]
            parts.append((mix(h[:-gap] * U(salt) + h[gap:]) & low)[good])
            docs.append(d[gap:][good])
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


@dataclass
class Model:
    """Bias, and the weights that are not zero by feature number."""

    bias: float
    index: np.ndarray
    weight: np.ndarray
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w

    def scores(self, words: Words, dense: np.ndarray) -> np.ndarray:
        f, d = features(words, self.bits)
        w = dense[f]
        f, d = f[w != 0], d[w != 0]
        both = np.unique((d << self.bits) | f)
        z = self.bias + np.bincount(both >> self.bits, dense[both & ((1 << self.bits) - 1)].astype(float), words.n_docs)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: Iterator[tuple[np.ndarray, int]] | list, *, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 3) -> Model:
    """Weights after the given passes over (distinct features, label); the bias is a coordinate without L1."""
    rows = list(rows)
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        share = (ones + 0.5) / (len(rows) + 1)
        return Model(math.log(share / (1 - share)), np.zeros(0, np.int64), np.zeros(0, np.float32), bits)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    last = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        za, sparse = z[at], np.where(at == last, 0.0, l1)
        return np.where(np.abs(za) <= sparse, 0.0, -(za - np.sign(za) * sparse) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for f, y in rows:
            at = np.append(f, last)
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(last + 1))
    index = np.flatnonzero(w[:last])
    bias = float(w[last]) - cut(np.array([w[f].sum() + w[last] for f, _ in rows]), np.array([y for _, y in rows]))
    return Model(bias, index, w[index].astype(np.float32), bits)


def cut(z: np.ndarray, y: np.ndarray) -> float:
    """The margin, halfway between two rows, from which on rows count as label 1 with the best F1."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    f1[:-1][z[:-1] == z[1:]] = 0
    best = int(np.argmax(f1))
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best]) - 1e-6


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", only: Column | None = None, max_rows: int = MAX_ROWS, bits: int = BITS, **rates) -> Model:
    """Model from labelled documents; only is a condition on the id (a column named doc_id)."""
    one = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("__y")).where("doc_id is not null and __y is not null")
    one = one if only is None else one.where(only)
    order = F.xxhash64("doc_id", F.lit(17)), "doc_id"
    few = one.groupBy("doc_id").agg(F.max("__y").alias("__y")).orderBy(*order).limit(max_rows)
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(few), "doc_id")  # few has at most max_rows rows

    def make():
        def each(texts, _):
            words = Words(*utf8_parts(texts), ALNUM)
            f, d = features(words, bits)
            both = np.unique((d << bits) | f)
            cuts = np.searchsorted(both, np.arange(words.n_docs + 1) << bits)
            both = (both & ((1 << bits) - 1)).astype(np.uint32)
            return [pa.array([both[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]

        return each

    got = map_docs(found, "text", ["doc_id", "__y"], T.StructType([T.StructField("f", T.BinaryType())]), make)
    rows = got.dropDuplicates(["doc_id"]).orderBy(*order).select("f", "__y").toLocalIterator()
    return ftrl([(np.frombuffer(r.f, np.uint32).astype(np.int64), int(r["__y"] > 0)) for r in rows], bits=bits, **rates)


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Kept columns with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights at most

    def make():
        model, dense = shared.value, shared.value.dense()
        return lambda texts, _: [model.scores(Words(*utf8_parts(texts), ALNUM), dense)]

    return map_docs(docs, text, list(docs.columns if keep is None else keep), T.StructType([T.StructField(name, T.DoubleType())]), make)
