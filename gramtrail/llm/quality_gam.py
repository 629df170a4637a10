"""Quality by a generalised additive model with pairwise interactions.

A text is some numbers about it: lengths, shares of kinds of characters, repetition of words and lines. Each number is cut into bins
at quantiles of the training rows. Boosting goes round the features in turn, again and again: a tree of depth two on one feature, fitted to the
gradient of the log loss, adds a little to that feature's table. Then the pairs of features whose four quadrants explain most of what is
left get tables of their own in the same way. A score is the sum of one entry of each table, looked up for all texts of a batch at once.

Training takes at most `max_rows` labelled rows, those with the smallest hash of the id (a documented bound; every row is scored). Cases:
without labelled rows of both kinds the score is the smoothed share of label 1 (0.5 without any); a null, empty or wordless text has all numbers 0 and
gets a score as any other; texts of any length are read whole; of several labels of one id the largest holds; null labels are left
out; repeated rows each get a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import SPACED, Words, grams, map_docs, utf8_parts

MAX_ROWS = 6000
BINS, PAIR_BINS, PAIRS = 32, 12, 8

_all = np.arange(256)
_LINE = _all != 10
_KINDS = {
    "upper": (_all >= 65) & (_all <= 90), "lower": (_all >= 97) & (_all <= 122), "digits": (_all >= 48) & (_all <= 57), "wide": _all >= 128, "ends": np.isin(_all, list(b".,;:")),
    "marks": np.isin(_all, list(b"!?")), "bars": np.isin(_all, list(b"|/\\_~")), "signs": np.isin(_all, list(b"#$%&*+<=>@^")), "quotes": np.isin(_all, list(b"\"'()[]{}`-")), "lines": _all == 10,
}
NAMES = ["words", "bytes_a_word", "longest", *_KINDS, "shouted", "bare", "same_as_last", "distinct", "commonest", "distinct_pairs", "lines_again", "words_a_line"]


def _sums(value: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(value)])
    return (total[edge[1:]] - total[edge[:-1]]).astype(float)


def _distinct(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: how many different values, and how often the commonest stands."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(h))))
    return np.bincount(d[at], minlength=n).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """The numbers of each text, a row each, in the order of NAMES."""
    data, offsets = utf8_parts(texts)
    words, n = Words(data, offsets, SPACED), len(offsets) - 1
    size, count = np.diff(offsets), words.count
    a_byte, a_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    length = words.end - words.start
    longest = np.zeros(n)
    np.maximum.at(longest, words.d, length)
    kinds = [_sums(is_kind[data], offsets) * a_byte for is_kind in _KINDS.values()]
    inside = {k: np.concatenate([[0], np.cumsum(_KINDS[k][data])]) for k in ("upper", "lower", "wide")}
    held = {k: s[words.end] - s[words.start] for k, s in inside.items()}
    shouted = np.bincount(words.d, (held["upper"] > 1) & (held["lower"] == 0), n) * a_word
    bare = np.bincount(words.d, held["upper"] + held["lower"] + held["wide"] == 0, n) * a_word
    again = np.zeros(n)
    if len(words.h) > 1:
        again = np.bincount(words.d[1:], (words.h[1:] == words.h[:-1]) & (words.d[1:] == words.d[:-1]), n) * a_word
    different, most = _distinct(words.h, words.d, n)
    pairs, good = grams(words.h, words.d, 2)
    two, _ = _distinct(pairs[good], words.d[: len(pairs)][good], n)
    lines = Words(data, offsets, _LINE)
    unlike, _ = _distinct(lines.h, lines.d, n)
    rows = lines.count
    cols = [
        np.log1p(count), _sums(length, words.first) * a_word, np.log1p(longest), *kinds, shouted, bare, again, different * a_word, most * a_word, two / np.maximum(count - 1, 1),
        1 - unlike / np.maximum(rows, 1), np.log1p(count / np.maximum(rows, 1)),
    ]
    out = np.column_stack(cols)
    out[count == 0] = 0
    return out


@dataclass
class Model:
    """Tables by feature and by pair of features; edges are where bins begin."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, k], "right")]
        bins = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {k for two in self.pairs for k in two}}
        for (i, j), table in self.pairs.items():
            z += table[bins[i], bins[j]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Halfway between the values on both sides of each quantile, so that equal values share a bin."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    low = np.unique(np.searchsorted(values, np.quantile(x, np.arange(1, bins) / bins, method="lower")))
    low = low[low < len(values) - 1]
    return (values[low] + values[low + 1]) / 2


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """The gain and place of the best cut of bins in two; the gain is 0 where none is."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + l2) + (g.sum() - a) ** 2 / (h.sum() - b + l2) - g.sum() ** 2 / (h.sum() + l2)
    k = int(np.argmax(gain))
    return max(float(gain[k]), 0.0), k + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """The step of each bin of one feature: a tree of depth two."""
    out, (gain, k) = np.zeros(len(g)), _best_cut(g, h, l2)
    if gain <= 0:
        return out
    for a, b in ((0, k), (k, len(g))):
        more, at = _best_cut(g[a:b], h[a:b], l2)
        for c, d in ((a, a + at), (a + at, b)) if more > 0 else ((a, b),):
            out[c:d] = -g[c:d].sum() / (h[c:d].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The gain and step of the best cut of a table of two features in four."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ga, ha, gain = a[-1:, :], b[-1:, :], 0.0
    sides = [(a, b), (ga - a, ha - b), (a[:, -1:] - a, b[:, -1:] - b), (a[-1, -1] - ga - a[:, -1:] + a, b[-1, -1] - ha - b[:, -1:] + b)]
    gain = sum(x * x / (np.maximum(y, 0) + l2) for x, y in sides) - a[-1, -1] ** 2 / (b[-1, -1] + l2)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, l2: float = 2.0, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS) -> Model:
    """Tables for numbers x and labels y (0 or 1)."""
    ones = float(y.sum())
    share = (ones + 0.5) / (len(y) + 1)
    model = Model(math.log(share / (1 - share)))
    if not 0 < ones < len(y):
        return model
    n = x.shape[1]
    model.edges, model.pair_edges = [_edges(x[:, k], bins) for k in range(n)], [_edges(x[:, k], pair_bins) for k in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)), l2)
            table += step
            z += step[at[k]]

    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def cells(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        flat = coarse[i] * shape[j] + coarse[j]
        return _quadrants(*[np.bincount(flat, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h)], l2)

    gains = sorted(((cells(i, j)[0], i, j) for i in range(n) for j in range(i + 1, n) if shape[i] > 1 and shape[j] > 1), key=lambda r: (-r[0], r[1], r[2]))
    model.pairs = {(i, j): np.zeros((shape[i], shape[j])) for gain, i, j in gains[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * cells(i, j)[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", only: Column | None = None, max_rows: int = MAX_ROWS, **rates) -> Model:
    """Model from labelled documents; only is a condition on the id (a column named doc_id)."""
    one = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("__y")).where("doc_id is not null and __y is not null")
    one = one if only is None else one.where(only)
    order = F.xxhash64("doc_id", F.lit(29)), "doc_id"
    few = one.groupBy("doc_id").agg(F.max("__y").alias("__y")).orderBy(*order).limit(max_rows)
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(few), "doc_id")  # few has at most max_rows rows
    got = map_docs(found, "text", ["doc_id", "__y"], T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), lambda: lambda texts, _: [pa.array(list(features(texts)), pa.list_(pa.float64()))])
    rows = got.groupBy("doc_id").agg(F.min(F.struct("x", "__y")).alias("r")).orderBy(*order).select("r.*").collect()  # at most max_rows rows of numbers
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(NAMES))
    return fit(x, np.array([float(r["__y"] > 0) for r in rows]), **rates)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Kept columns with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def make():
        own = shared.value
        return lambda texts, _: [own.scores(features(texts))]

    return map_docs(docs, text, list(docs.columns if keep is None else keep), T.StructType([T.StructField(name, T.DoubleType())]), make)
