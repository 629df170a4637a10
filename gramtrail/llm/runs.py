"""Periodic runs of words, by way of the longest previous factors.

The words of a chunk of documents are symbols of one sequence, of which no two documents share one.
Prefix doubling gives its suffix array, and the ranks of each doubling answer how far two places agree, forwards and backwards; the
least common prefixes of neighbours and the nearest smaller places in suffix order give the longest previous
factor of each place, hence the Lempel-Ziv blocks. A run that touches a border of blocks is found by extending a match
at that border (Main): its period is at most the length of both blocks by the least exponent less one. A run strictly inside a block is a copy of
one inside the block's source; runs lie in buckets by their start and are copied from left to right.

A run is a maximal stretch with smallest period q of at least max(`least`, `exponent` * q) words. Cases: a null, empty or wordless
text has no words and no runs; texts of any length are read whole, in memory of about 100 bytes a word of the chunk (a megabyte of text, or one
longer document); repeated rows, ids and copies each get their own row; a row without an id has its words as they stand.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import SPACED, U, Words, free_name, map_docs, mix, utf8_parts

LEAST, EXPONENT = 6, 4


class Suffixes:
    """Suffix array of symbols with the ranks by the first 2**k symbols for each k, and the common prefixes of neighbours."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        sa = np.argsort(symbols, kind="stable")
        s = symbols[sa]
        new = np.ones(n, bool)
        new[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.ranks, parted, k = [rank.astype(np.int32)], np.where(new, 0, -1), 0
        while True:
            alone = new & np.append(new[1:], True)
            at = np.flatnonzero(~alone)  # places of the array whose suffixes still agree with a neighbour
            if not len(at):
                break
            rank, pos = self.ranks[-1], sa[at]
            after = np.where(pos + (1 << k) < n, rank[np.minimum(pos + (1 << k), n - 1)], -1)
            key = rank[pos].astype(np.int64) * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            sa[at], key = pos[order], key[order]
            k += 1
            fresh = np.ones(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            parted[at[fresh & ~new[at]]] = k
            new[at] |= fresh
            rank = rank.copy()
            rank[sa[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
            self.ranks.append(rank)
        self.sa = sa
        lcp = np.zeros(n, np.int64)
        for level in range(1, k + 1):  # parted at this level: 2**(level - 1) symbols agree, not twice as many
            at = np.flatnonzero(parted == level)
            lcp[at] = self.ahead(sa[at - 1], sa[at], level - 1, 1 << (level - 1))
        self.lcp = lcp

    def ahead(self, i: np.ndarray, j: np.ndarray, levels: int | None = None, known: int = 0) -> np.ndarray:
        """How many symbols agree from i and from j on."""
        out = np.full(len(i), known, np.int64)
        for k in range((len(self.ranks) if levels is None else levels) - 1, -1, -1):
            a, b, rank = i + out, j + out, self.ranks[k]
            inside = np.maximum(a, b) < self.n
            same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)]) & (a != b)
            out[same] += 1 << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree before i and before j, i < j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b, rank = i - out - (1 << k), j - out - (1 << k), self.ranks[k]
            out[(a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])] += 1 << k
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest factor of each place that also begins at an earlier place, and such a place."""
        n, sa = self.n, self.sa
        length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for step in (-1, 1):
            near = np.arange(n) + step  # in suffix order; all between are later places
            agree = self.lcp.copy() if step < 0 else np.append(self.lcp[1:], 0)
            live = np.flatnonzero(agree > 0)
            while len(live):
                late = live[sa[near[live]] > sa[live]]
                if not len(late):
                    break
                hop = near[late]
                agree[late], near[late] = np.minimum(agree[late], agree[hop]), near[hop]
                live = late[agree[late] > 0]
            at = np.flatnonzero(agree > 0)
            longer = at[agree[at] > length[sa[at]]]
            length[sa[longer]], source[sa[longer]] = agree[longer], sa[near[longer]]
        return length, source


def blocks(length: list[int], start: int, end: int) -> list[int]:
    """Where Lempel-Ziv blocks begin in [start, end), and the end."""
    out, i = [], start
    while i < end:
        out.append(i)
        i += length[i] or 1
    out.append(end)
    return out


def runs(symbols: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run of each document, by start, then period.

    Document i has the symbols from first[i] to first[i + 1]; documents share no symbols. exponent is 2 or more.
    """
    n_docs, n = len(first) - 1, len(symbols)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_docs)]
    if n < least:
        return out
    own = Suffixes(symbols)
    length, source = own.previous()
    hops = length.tolist()
    cuts = [blocks(hops, a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    at = np.array([c for own_cuts in cuts for c in own_cuts], np.int64)
    doc = np.repeat(np.arange(n_docs), [len(c) for c in cuts])
    inner = doc[1:] == doc[:-1]
    size = np.where(inner, at[1:] - at[:-1], 0)
    most = (np.append(0, size) + np.append(size, 0)) // (exponent - 1)  # of both blocks at a border
    at, doc, most = at[most > 0], doc[most > 0], most[most > 0]
    border, bound = np.repeat(at, most), np.repeat(doc, most)
    period = np.arange(len(border)) - np.repeat(np.cumsum(most) - most, most) + 1
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(n_docs)]
    for left in (border, border - period):  # words agree with those a period on, from here or up to here
        low, high = first[bound], first[bound + 1]
        fits = np.flatnonzero((left >= low) & (left + period <= high))
        a, p, low, high, d = left[fits], period[fits], low[fits], high[fits], bound[fits]
        need = np.maximum((np.maximum(exponent * p, least) - p + 1) // 2, 1)  # of so many agreeing words one side holds half
        on, back = np.ones(len(a), bool), np.ones(len(a), bool)
        for step in range(3):
            asked = step < need
            i = np.minimum(a + step, n - 1)
            on &= ~asked | ((a + step + p < high) & (symbols[i] == symbols[np.minimum(a + step + p, n - 1)]))
            i = np.maximum(a - 1 - step, 0)
            back &= ~asked | ((a - 1 - step >= low) & (symbols[i] == symbols[np.minimum(i + p, n - 1)]))
        may = np.flatnonzero(on | back)
        a, p, d = a[may], p[may], d[may]
        begin, end = a - own.behind(a, a + p), a + p + own.ahead(a, a + p)
        good = end - begin >= np.maximum(exponent * p, least)
        for k, b, e, q in zip(d[good].tolist(), begin[good].tolist(), end[good].tolist(), p[good].tolist(), strict=True):
            found[k][b, e] = min(q, found[k].get((b, e), q))
    for k, own_cuts in enumerate(cuts):
        if found[k]:
            _copy(found[k], own_cuts, source, least)
            out[k] = sorted((b - int(first[k]), e - b, q) for (b, e), q in found[k].items())
            out[k].sort(key=lambda r: (r[0], r[2]))
    return out


def _copy(found: dict[tuple[int, int], int], cuts: list[int], source: np.ndarray, least: int) -> None:
    """Add the runs strictly inside each block, which are copies of earlier ones."""
    buckets: dict[int, dict[int, int]] = defaultdict(dict)
    for (b, e), q in found.items():
        buckets[b][e] = q
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end - start < least + 2:
            continue
        back = start - int(source[start])
        for b in range(start + 1, end - least):
            for e, q in list(buckets.get(b - back, {}).items()):
                if e + back < end and e + back not in buckets[b]:
                    buckets[b][e + back] = found[b, e + back] = q


FIELDS = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("collapsed", T.StringType()),
])
DIGESTS = T.StructType([*FIELDS.fields[:5], T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])


def looped(n: int, seed: int) -> np.ndarray:
    """Which original word stands at each place of a document whose words repeat from a place on, as its seed says."""
    at = np.arange(n)
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which words no run holds after its first period; None for all."""
    if not found:
        return None
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _joined(data: np.ndarray, words: Words, source: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space; source is the word that stands at each place."""
    take = source[keep]
    size = words.end[take] - words.start[take] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    place = np.repeat(words.start[take] - (ends - size), size) + np.arange(len(out))
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = data[place[word]]
    last = np.append(0, np.cumsum(keep))[words.first]
    ends = np.append(0, ends)
    whole = out.tobytes()
    return [whole[ends[a] : ends[b] - 1] if b > a else b"" for a, b in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, seed=None, digests: bool = False, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Kept columns with n_runs, the longest run (start, length, period, exponent_milli), all runs and the collapsed text.

    Ties of length go to the smaller start, then period. seed is a column of numbers: where it is a multiple of ten, the words are looped by
    it before they are searched (a test of strength); without it they are taken as they stand. digests asks for runs_sha256 (start,length,period and a line end
    for each run) and collapsed_sha256 in place of runs and collapsed.
    """
    keep, fields = list(docs.columns if keep is None else keep), DIGESTS if digests else FIELDS
    name = free_name("__seed", docs.columns)
    rows = docs.withColumn(name, F.lit(None).cast("long") if seed is None else seed.cast("long"))

    def make():
        def each(texts, batch):
            data, offsets = utf8_parts(texts)
            words = Words(data, offsets, SPACED, fold=False)
            seeds = batch.column(batch.schema.names.index(name)).to_pylist()
            source = np.arange(len(words.h))
            for i, s in enumerate(seeds):
                n, a = int(words.count[i]), int(words.first[i])
                if s is not None and s % 10 == 0 and n:
                    source[a : a + n] = a + looped(n, s)
            found = runs(mix(words.h ^ mix(words.d.astype(U)))[source], words.first, least, exponent)
            stay = np.ones(len(source), bool)
            for i, own in enumerate(found):
                if own:
                    stay[words.first[i] : words.first[i + 1]] = kept(int(words.count[i]), own)
            best = [min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None) for own in found]
            milli = [None if r[1] is None else 1000 * r[1] // r[2] for r in best]
            made = _joined(data, words, source, stay)
            whole = pa.int64()
            first = [pa.array([len(own) for own in found], whole), *[pa.array([r[i] for r in best], whole) for i in range(3)], pa.array(milli, whole)]
            if not digests:
                return [*first, pa.array([[list(r) for r in own] for own in found], pa.list_(pa.list_(whole))), pa.array([m.decode() for m in made], pa.string())]
            listed = ["".join(f"{s},{n},{q}\n" for s, n, q in own) for own in found]
            return [*first, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()), pa.array([hashlib.sha256(m).hexdigest() for m in made], pa.string())]

        return each

    mine = [c for c in keep if c not in fields.fieldNames()]
    out = map_docs(rows, text, [*mine, name], fields, make)
    return out.drop(name)
