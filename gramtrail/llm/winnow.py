"""Benchmark decontamination by winnowing.

A window is `span` consecutive words of a benchmark item (all words of a shorter item).
Of every `span - k + 1` consecutive k-gram hashes the smallest is a fingerprint, on both
sides alike, so a shared window always shares a fingerprint. Fingerprints of documents are
joined with those of the items, and each hit is extended word by word in both directions;
runs that hold a whole window count.

Cases: a null or wordless text has no words, no hits and the digest of no items; a null
or wordless item, or one without an id, is no item; items with one id count once; repeated
documents give a row each; texts of any length are read whole; all other columns are kept unless keep
names those to keep, whatever their names, but give way to those of the result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import ALNUM, Words, free_name, grams, map_docs, utf8_parts

SPAN, K = 10, 5
#: Text of the items that one index holds; more items are taken in several passes over the documents.
INDEX_BYTES = 32 << 20
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])
PARTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def chosen(g: np.ndarray, good: np.ndarray, w: int) -> np.ndarray:
    """Which k-grams are the least of some w consecutive ones that are all good (equal least ones are all chosen)."""
    n = len(g) - w + 1
    out = np.zeros(len(g), bool)
    if n <= 0:
        return out
    least, whole = g[:n].copy(), good[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
        whole &= good[j : j + n]
    for j in range(w):
        out[j : j + n] |= whole & (g[j : j + n] == least)
    return out


class Index:
    """Fingerprints of items: for each gram length the sorted hashes and who has them where."""

    def __init__(self, ids: list[str], texts: list[str], span: int = SPAN, k: int = K):
        self.span, self.k = span, min(k, span)
        words = Words(*utf8_parts(pa.array(texts, pa.string())), ALNUM)
        self.ids = ids
        self.words = [words.h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        where: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item, h in enumerate(self.words):
            if not len(h):
                continue
            size = self.k if len(h) >= span else len(h)
            g, good = grams(h, np.zeros(len(h), int), size)
            picks = np.flatnonzero(chosen(g, good, span - self.k + 1)) if len(h) >= span else [0]
            for p in picks:
                where[size if len(h) >= span else -size][int(g[p])].append((item, int(p)))
        self.where = {size: dict(x) for size, x in where.items()}
        self.keys = {size: np.array(sorted(x), np.uint64) for size, x in where.items()}

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Hit words of a chunk, and the items with occurring windows of each document."""
        hit = np.zeros(len(words.h), bool)
        items: dict[int, set[int]] = defaultdict(set)
        seen = set()
        for size, keys in self.keys.items():
            g, good = grams(words.h, words.d, abs(size))
            if size > 0:
                good = chosen(g, good, self.span - self.k + 1)
            at = np.searchsorted(keys, g)
            for i in np.flatnonzero(good & (keys[np.minimum(at, len(keys) - 1)] == g)):
                for item, p in self.where[size][int(g[i])]:
                    key = item, int(words.d[i]), int(i) - p
                    if key not in seen:
                        seen.add(key)
                        self._extend(words, *key, hit, items)
        return hit, items

    def _extend(self, words: Words, item: int, doc: int, diagonal: int, hit: np.ndarray, items: dict) -> None:
        own = self.words[item]
        a, b = max(diagonal, int(words.first[doc])), min(diagonal + len(own), int(words.first[doc + 1]))
        need = min(self.span, len(own))
        if b - a < need:
            return
        same = np.concatenate([[False], words.h[a:b] == own[a - diagonal : b - diagonal], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in edge[edge[:, 1] - edge[:, 0] >= need]:
            hit[a + s : a + e] = True
            items[doc].add(item)


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of bounded text; the driver holds one block at a time."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("i is not null and t is not null")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t.encode())
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, span: int = SPAN, k: int = K, index_bytes: int | None = None) -> DataFrame:
    """Kept columns with n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    The index of a block of items has a bounded size and is broadcast; where the items need
    several blocks, the documents are scanned once for each and the findings are merged by row.
    """
    sc, keep = docs.sparkSession.sparkContext, list(docs.columns if keep is None else keep)
    blocks = _blocks(items, item_id, item_text, index_bytes or INDEX_BYTES)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        shared = sc.broadcast(Index(*first, span=span, k=k))

        def make():
            index = shared.value

            def each(texts, _):
                words = Words(*utf8_parts(texts), ALNUM)
                hit, found = index.hits(words)
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
                ids = [{index.ids[i] for i in found.get(d, ())} for d in range(words.n_docs)]
                return [words.count.astype(np.int64), n_hit.astype(np.int64), np.array([len(x) for x in ids], np.int64), pa.array([_digest(x) for x in ids], pa.string()), n_hit > 0]

            return each

        return map_docs(docs, text, keep, FIELDS, make)

    # More items than one index holds: a pass for each block, then hit words and items merged for each row.
    key = free_name("__key", docs.columns)
    row = docs.withColumn(key, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}), 256))
    found = None
    for ids, texts in [first, second, *blocks]:
        shared = sc.broadcast(Index(ids, texts, span=span, k=k))

        def make(shared=shared):
            index = shared.value

            def each(texts, _):
                words = Words(*utf8_parts(texts), ALNUM)
                hit, got = index.hits(words)
                at = [np.flatnonzero(hit[a:b]).astype(np.int32) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                return [words.count.astype(np.int64), pa.array(at, pa.list_(pa.int32())), pa.array([sorted({index.ids[i] for i in got.get(d, ())}) for d in range(words.n_docs)], pa.list_(pa.string()))]

            return each

        part = map_docs(row, text, [key], PARTS, make).dropDuplicates([key])
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy(F.col(key).alias("__key")).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    merged = merged.select("__key", "n_words", F.size("h").cast("long").alias("n_hit"), F.size("i").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "i").cast("binary"), 256).alias("items_sha256"), (F.size("h") > 0).alias("contaminated"))
    own = [c for c in keep if c not in FIELDS.fieldNames()]
    merged = merged.withColumnRenamed("__key", key)
    return row.select(key, *[F.col(f"`{c}`") for c in own]).join(merged, key).select(*[F.col(f"`{c}`") for c in own], *FIELDS.fieldNames())
