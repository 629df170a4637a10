"""Substring dedup over sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, or at a line end. Runs of sentences with at least `min_words` words are
hashed (words lower-cased in A-Z, white space ignored). With `sentences` given, these are the runs of so many consecutive
sentences. With None they grow: from each sentence on, and back from each, until they hold `min_words` words, be it one
sentence or ten. Sentences of more than LONG words are split for that after the words that are the least by hash of any
WINDOW words in a row, so that texts which share more than 50 words in a row and their line ends share a run of ten words
or more there, however the rest of a sentence cut off at either end goes on.

The first occurrence of a hash is the one with the least (doc_id, version, place); sentences (or pieces of split ones) that any other
occurrence covers are removed, with the white space after them. n_removed counts the sentences that lose words.

Cases: a null or empty text has no sentences and stays as it is; texts with fewer sentences have no
span; rows with one doc_id and other texts are versions of it, told apart and ordered by a hash of the text, and each loses
its own places; of rows with one doc_id and one text all but one are copies, which lose all that a span covers; rows without a
doc_id stay as they are; other columns stay, whatever their names, but give way to n_sentences and n_removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textops import SPACED, U, Words, _powers, free_name, grams, map_docs, mix, utf8_parts

SENTENCES, MIN_WORDS = 2, 10
#: Sentences of more words are split where runs grow, and the window whose least word ends a piece. Of 51 shared words, the
#: cut-off sentence at one end has over 20 if the whole ones between hold under ten; 15 of these may go until the cuts agree.
LONG, WINDOW = 20, 8
_POWER = 0xA0761D6478BD642F


def cuts(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words after which long sentences are split; last are the last words of the sentences."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    v, best = mix(h ^ U(0x3C79AC492BA7B653)), np.arange(m)
    least = v[:m]
    for j in range(1, WINDOW):
        lower = v[j : j + m] <= least
        least, best = np.where(lower, v[j : j + m], least), np.where(lower, np.arange(j, j + m), best)
    size = np.diff(last, prepend=-1)
    end = np.repeat(np.where(size > LONG, last, -1), size)[:m]
    return best[np.arange(m) + WINDOW - 1 <= end]


class Sentences:
    """Sentences of a chunk, or their pieces: hash, words, document, and byte range from the first word to the next one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, split: bool = False):
        words = Words(data, offsets, SPACED)
        n = len(words.h)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        ends = np.zeros(n, bool)
        if n:
            ends = np.isin(data[words.end - 1], np.frombuffer(b".!?", np.uint8))
            ends[:-1] |= (words.d[1:] != words.d[:-1]) | (lines[words.start[1:]] > lines[words.end[:-1]])
            ends[-1] = True
        whole = ends.copy()
        if split:
            ends[cuts(words.h, np.flatnonzero(ends))] = True
        last = np.flatnonzero(ends)
        first = np.concatenate([[0], last[:-1] + 1]) if n else last
        place = np.arange(n) - np.repeat(first, last - first + 1) if n else last
        power = np.multiply.accumulate(np.concatenate([[1], np.full(int(place.max()) if n else 0, _POWER)]).astype(U)) if n else np.zeros(0, U)
        self.h = mix(np.add.reduceat(words.h * power[place], first)) if n else np.zeros(0, U)
        self.words, self.d = last - first + 1, words.d[first] if n else first
        self.n_docs, self.of = words.n_docs, words.h
        self.sentence = np.cumsum(whole)[last] - 1 + ~whole[last]  # number of the sentence in the chunk
        self.start = words.start[first] if n else first
        self.first = np.searchsorted(self.d, np.arange(self.n_docs + 1))

    def spans(self, sentences: int | None, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first sentence and number of sentences of the runs that count, by first sentence."""
        sums = np.concatenate([[0], np.cumsum(self.words)])
        if sentences is not None:
            h, good = grams(self.h, self.d, sentences)
            at = np.flatnonzero(good & (sums[sentences:] - sums[: len(sums) - sentences] >= min_words)[: len(good)])
            return h[at], at, np.full(len(at), sentences)
        n = len(self.words)
        on = np.searchsorted(sums, sums[:-1] + min_words)  # the shortest run from each sentence on
        back = np.searchsorted(sums, sums[1:] - min_words, "right") - 1  # and up to each
        a, b = np.concatenate([np.arange(n), back]), np.concatenate([on, np.arange(1, n + 1)])
        good = (a >= 0) & (b <= n)
        good[good] = self.d[a[good]] == self.d[b[good] - 1]
        a, size = np.divmod(np.unique(a[good] * (min_words + 1) + b[good] - a[good]), min_words + 1)  # a sentence has a word at least
        p, inv = _powers(len(self.of) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(self.of * p[: len(self.of)], dtype=U)])
        x, y = sums[a], sums[a + size]
        return mix((total[y] - total[x]) * inv[x] + (y - x).astype(U)), a, size


def spans(rows: DataFrame, *, sentences: int | None, min_words: int) -> DataFrame:
    """hash, doc_id, version and place of every span of rows(text, doc_id, version); a place is the first sentence and the number of sentences in one."""
    base = (min_words if sentences is None else sentences) + 1

    def make():
        def each(texts, _):
            own = Sentences(*utf8_parts(texts), sentences is None)
            h, at, size = own.spans(sentences, min_words)
            cuts = np.searchsorted(own.d[at], np.arange(own.n_docs + 1))
            place = (at - own.first[own.d[at]]) * base + size
            offsets = pa.array(cuts.astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int64)))]

        return each

    fields = T.StructType([T.StructField("h", T.ArrayType(T.LongType())), T.StructField("p", T.ArrayType(T.LongType()))])
    got = map_docs(rows.where("doc_id is not null"), "text", ["doc_id", "version"], fields, make)
    return got.select("doc_id", "version", F.explode(F.arrays_zip("h", "p")).alias("s")).select(F.col("s.h").alias("hash"), "doc_id", "version", F.col("s.p").alias("place"))


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", sentences: int | None = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns, the text without repeated spans, and n_sentences and n_removed."""
    base = (min_words if sentences is None else sentences) + 1
    version, copy, lost = (free_name(x, docs.columns) for x in ("__version", "__copy", "__gone"))
    own_id, whole = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    once = not docs.where(own_id.isNotNull()).groupBy(own_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if once:
        rows = docs.withColumns({version: F.lit(0).cast("long"), copy: F.lit(False)})
    else:  # an id that comes more than once: its texts are versions, and of rows with one text all but one are copies
        rows = docs.withColumn(version, F.xxhash64(whole, F.length(whole)))
        again = written(rows.where(own_id.isNotNull()).groupBy(own_id.alias("i"), F.col(version).alias("v")).agg(F.count("*").alias("n")).where("n > 1").select("i", "v"), "span-copies")
        same = own_id.eqNullSafe(F.col("i")) & (F.col(version) == F.col("v"))
        number = free_name("__number", docs.columns)
        some = written(rows.join(again, same, "left_semi").withColumn(number, F.monotonically_increasing_id()), "span-rows")
        least = some.groupBy(own_id.alias("i"), F.col(version).alias("v")).agg(F.min(number).alias("least"))
        some = some.join(least, same).withColumn(copy, F.col(number) != F.col("least")).drop(number, "i", "v", "least")
        rows = rows.join(again, same, "left_anti").withColumn(copy, F.lit(False)).unionByName(some)
    every = spans(rows.where(~F.col(copy)).select(whole.alias("text"), own_id.alias("doc_id"), F.col(version).alias("version")), sentences=sentences, min_words=min_words)
    at = F.struct("doc_id", "version", "place")
    first = every.groupBy("hash").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    again = every.join(first, "hash").where(at != F.col("first"))
    gone = again.groupBy(F.col("doc_id").alias("i"), F.col("version").alias("v")).agg(F.collect_set("place").alias("g"))  # places of one document
    both = rows.join(gone, (own_id == F.col("i")) & (F.col(version) == F.col("v")), "left").withColumn(lost, F.col("g")).select(*[F.col(f"`{c}`") for c in [*docs.columns, copy, lost]])

    def make():
        def each(texts, part):
            data, offsets = utf8_parts(texts)
            own = Sentences(data, offsets, sentences is None)
            gone, copies = (part.column(part.schema.names.index(x)).to_pylist() for x in (lost, copy))
            if any(copies):  # these lose whatever a span covers
                _, at, size = own.spans(sentences, min_words)
                places = (at - own.first[own.d[at]]) * base + size
                gone = [places[own.d[at] == d].tolist() if c else g for d, (c, g) in enumerate(zip(copies, gone, strict=True))]
            out, removed = texts.to_pylist(), np.zeros(own.n_docs, np.int64)
            for d, places in enumerate(gone):
                if not places:
                    continue
                a, b = own.first[d], own.first[d + 1]
                if a == b:
                    continue
                at, size = np.divmod(np.array(places), base)
                cover = np.zeros(b - a, bool)
                for j in range(size.max()):
                    cover[np.minimum(at[size > j] + j, b - a - 1)] = True
                edges = np.append(own.start[a:b], offsets[d + 1])
                keep = [data[offsets[d] : edges[0]].tobytes(), *[data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~cover)]]
                out[d], removed[d] = b"".join(keep).decode("utf-8", "replace"), len(np.unique(own.sentence[a:b][cover]))
            n = np.bincount(own.d, np.diff(own.sentence, prepend=-1) > 0, own.n_docs)
            return [pa.array(out, pa.string()), n.astype(np.int64), removed]

        return each

    fields = T.StructType([T.StructField(text, T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = map_docs(both, text, [*docs.columns, copy, lost], fields, make)
    own = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return out.select(*[F.col(f"`{c}`") for c in own], "n_sentences", "n_removed")
