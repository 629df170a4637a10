"""Language-model scoring with an Elias-Fano n-gram trie.

A trigram model that merges counts: p(w | u, v) = (c(u, v, w) + k * (c(v, w) + mu * p(w))) / (c(u, v) + k * (c(v) + mu)),
with p(w) = c(w) / (all + 1), and 1 / (all + 1) for all unknown words together; it sums to one. Counts cover all
training texts; before a text are two starts, after it an end, which is a word.

The counts of the `head` most frequent words are broadcast; those of the others are found in the shards, so that the
head decides about cost alone. The trie is split into shards by the word of a pair that is not of the head, the
successor if neither is, and by both words if both are; so all occurrences of a rarer word as a successor meet in its shard,
which hence knows its count. A shard has at least the events of one pair of head words, however many they are. log10 p(w | u, v) is the share of w, the gains of pair and
triple over that, k * mu, and less the denominator; the shard of (v, w) gives the former, and for the next
event, whose context (v, w) is, the denominator, as it has c(v, w) and c(w). A shard is built from the events that meet in
it: sorted contexts v; pointers to their successors w; pointers from these to the words u before the pair. The numbers of a level are
those within the shard, set apart by their context, so that each level rises and is an Elias-Fano sequence; gains
and denominators are quantised to a byte. Each distinct event is answered by search between the pointers of its context.
Levels are flat buffers that are used in place: Shard.open maps a file, but the shards of a job are
buffers of the task that asks them, as the shared folder may be a store that only Spark can read.

One shuffle carries the events, packed by block of documents and shard; a second brings the blocks the sums of their documents by
shard, with scores in units of 1 / FINE.

Cases: a null or empty text is its end alone; rows without an id are scored and not learnt from; rows with one id and
other texts are separate; repeated rows count each and get a row each; without training texts every
word has the share of an unknown one; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elias_fano import EliasFano
from .shared import written
from .textops import SPACED, U, Words, mix, packed_bytes, release, slices, unpacked_bytes, utf8_parts

HEAD, MU, MERGE = 100_000, 64.0, 0.05
#: Events of a block, which a task packs at once, and of a shard, on average.
BLOCK_EVENTS, SHARD_EVENTS = 1_000_000, 1_000_000
STEP = 1 / 24  # gains are at most log10(1 + tokens / mu) or so
FINE = 4096  # units of a score in an answer
END, START = 0, 1  # codes; words of the head follow
OTHER_V, OTHER_W, OTHER_U = U(1) << U(56), U(1) << U(40), U(1) << U(40)


@dataclass
class Unigrams:
    """Counts of the head by hash, and the totals."""

    hashes: np.ndarray
    counts: np.ndarray
    docs: int
    tokens: int  # training words and ends
    types: int  # distinct ones
    events: int  # words and ends of all documents

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Code of each word: a number from 2 on for the head, else 0."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        return np.where(self.hashes[at] == h, at + 2, 0) if len(self.hashes) else np.zeros(len(h), np.int64)

    def by_code(self) -> np.ndarray:
        """Counts of end, start and the head."""
        return np.concatenate([[self.docs, self.docs], self.counts]).astype(np.int64)


class Shard:
    """A trie shard in one buffer, used in place; open() maps a file.

    contexts: sorted codes of contexts. pointers: where the successors of each context begin. successors: their numbers
    among the sorted words, each set apart by its context, so that the whole level rises. gain: log10 of
    p(w | v) over the share of w and the back-off weight of v, by place.
    """

    def __init__(self, buffer):
        view, at = memoryview(buffer), 0

        def part(kind):
            nonlocal at
            (size,) = struct.unpack_from("<q", view, at)
            out = np.frombuffer(view, kind, size // np.dtype(kind).itemsize, at + 8)
            at += 8 + -(-size // 8) * 8
            return out

        def sequence():
            n, bits = part(np.int64)
            return EliasFano(int(n), int(bits), part(np.uint8), part(np.uint8))

        self.words, self.contexts, self.pointers, self.successors, self.before, self.pointers2, self.pairs2 = (sequence() for _ in range(7))
        self.own, self.gain, self.under, self.gain2 = part(np.int64), part(np.uint8), part(np.uint8), part(np.uint8)

    @classmethod
    def open(cls, path: str) -> "Shard":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(v: np.ndarray, w: np.ndarray, u: np.ndarray, n: np.ndarray, uni: Unigrams, mu: float, k: float) -> bytes:
        """A shard from distinct training events (codes of context, word and word before, sorted by these) and how often each occurs."""
        out: list[bytes] = []

        def put(x: np.ndarray) -> None:
            b = x.tobytes()
            out.extend([struct.pack("<q", len(b)), b, b"\0" * (-len(b) % 8)])

        pair = _firsts(v, w)
        times = np.add.reduceat(n, pair) if len(v) else np.zeros(0, np.int64)
        of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(v))))
        v2, w2 = v[pair], w[pair]
        words, wi = np.unique(w2, return_inverse=True)
        before, ui = np.unique(u, return_inverse=True)
        first = _firsts(v2)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v2))))
        own = np.bincount(wi, times, len(words)).astype(np.int64)
        share = mu * 10.0 ** word_shares(words, own, uni)[wi]
        levels = (words, v2[first], np.append(first, len(v2)), of * len(words) + wi, before, np.append(pair, len(v)), of_pair * len(before) + ui)
        for seq in levels:
            ef = EliasFano.build(seq.astype(U))
            put(np.array([ef.n, ef.bits], np.int64))
            put(ef.low)
            put(ef.high)
        put(own)
        put(quantised(np.log10(1 + times / share)))
        put(quantised(np.log10(1 + times / (k * (word_counts(words, own, uni)[wi] + mu)))))
        put(quantised(np.log10(1 + n / (k * (times + share)[of_pair]))))
        return b"".join(out)

    def find(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair, searched among the successors of its context, and the number of its word; -1 if there is none."""
        c, i = self.contexts.find(v), self.words.find(w)
        return _between(self.successors, self.pointers, c, i, self.words.n), i

    def find2(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The place of each triple, searched among the words before the pair at a place."""
        return _between(self.pairs2, self.pointers2, at, self.before.find(u), self.before.n)

    def parts(self, v: np.ndarray, w: np.ndarray, u: np.ndarray, of: np.ndarray, uni: Unigrams, mu: float, k: float) -> tuple[np.ndarray, np.ndarray]:
        """What events (pair number of, word before u) add to the score, and c(w) of each pair (v, w), 0 where w is of the head.

        Without the factor k * mu of every event. A pair adds its denominator, for the event after it, but for the end of a text.
        """
        at, i = self.find(v, w)
        own = np.where((i >= 0) & (w >= OTHER_W), self.own[i], 0) if len(self.own) else np.zeros(len(w), np.int64)
        gain, under = (np.where(at >= 0, value(x[at]), 0) if len(x) else np.zeros(len(w)) for x in (self.gain, self.under))
        p = word_shares(w, own, uni) + gain - np.where(w == U(END), 0, under + np.log10(k * (word_counts(w, own, uni) + mu)))
        at2 = self.find2(at[of], u)
        return p[of] + (np.where(at2 >= 0, value(self.gain2[at2]), 0) if len(self.gain2) else 0), own


def _between(level: EliasFano, pointers: EliasFano, context: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
    """Places of numbers among those of their context, -1 where there are none."""
    out, both = np.full(len(context), -1, np.int64), np.flatnonzero((context >= 0) & (number >= 0))
    c = context[both]
    out[both] = level.find((c * width + number[both]).astype(U), pointers.at(c).astype(np.int64), pointers.at(c + 1).astype(np.int64))
    return out


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def word_counts(w: np.ndarray, counts: np.ndarray, uni: Unigrams) -> np.ndarray:
    """c(w) of words; counts are those of words outside the head."""
    head = w < OTHER_W
    return np.where(head, uni.by_code()[np.where(head, w, U(0)).astype(np.int64)], counts)


def word_shares(w: np.ndarray, counts: np.ndarray, uni: Unigrams) -> np.ndarray:
    """log10 p of words; counts are those of words outside the head. A word that is not in the training texts has one share with all such."""
    return np.log10(np.maximum(word_counts(w, counts, uni), 1) / (uni.tokens + 1))


def shard_of(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """Shard of events: that of the word outside the head, the successor first; of both words where both are of the head."""
    both = mix(v * U(0x8CB92BA72F3D8DD7) + w)
    return (np.where(w >= OTHER_W, mix(w - OTHER_W), np.where(v >= OTHER_V, mix(v ^ OTHER_V), both)) % U(shards)).astype(np.int32)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x / STEP), 0, 255).astype(np.uint8)


def value(q: np.ndarray) -> np.ndarray:
    return q * STEP


def _counts(docs: DataFrame) -> DataFrame:
    """hash and count of training words, summed within each task; hash 0 counts documents and 1 events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, docs, events = [], 0, 0, 0

        def merged():
            h, c = np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
            u, i = np.unique(h, return_inverse=True)
            return u, np.bincount(i, c, len(u)).astype(np.int64)

        def rows(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        for batch in batches:
            for part in slices(batch):
                words = Words(*utf8_parts(part.column(0)), SPACED)
                learn = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                docs, events = docs + int(learn.sum()), events + len(words.h) + words.n_docs
                h, c = np.unique(words.h[learn[words.d]], return_counts=True)
                held.append((h, c))
                n_held += len(h)
                if n_held > 3_000_000:
                    held = [merged()]
                    n_held = len(held[0][0])
                    if n_held > 2_000_000:
                        yield rows(*held[0])
                        held, n_held = [], 0
        if held:
            yield rows(*merged())
        yield rows(np.array([0, 1], U), np.array([docs, events], np.int64))

    return docs.select("text", "learn").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def unigrams(docs: DataFrame, head: int) -> Unigrams:
    table = written(_counts(docs), "lm-words")
    special = {r.h: r.c for r in table.where("h in (0, 1)").collect()}
    real = table.where("h not in (0, 1) and c > 0")
    total = real.agg(F.sum("c"), F.count("*")).first()
    top = real.orderBy(F.desc("c"), "h").limit(head).toPandas()  # head rows at most
    h, c = top["h"].to_numpy(np.int64).view(U), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    n_docs = int(special.get(0) or 0)
    return Unigrams(h[order], c[order], n_docs, int(total[0] or 0) + n_docs, int(total[1]) + (n_docs > 0), int(special.get(1) or 0))


def _events(docs: DataFrame, uni, shards: int) -> DataFrame:
    """Events packed by block of documents and shard; and of each block its documents, with what the counts of the head say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, held, ids, n_held = uni.value, [], [], 0
        logs = np.log10(own.by_code() + 1.0)
        logs[START] = 0
        known = (own.by_code() > 0).astype(np.int64)
        block = TaskContext.get().partitionId() << 24

        def rows() -> pa.RecordBatch:
            pack = zstandard.ZstdCompressor(level=1)
            v, w, u, d, learn, size, base, n_known = (np.concatenate([x[k] for x in held]) for k in range(8))
            shard = shard_of(v, w, shards)
            order = np.argsort(shard, kind="stable")
            v, w, u, d, cuts = v[order], w[order], u[order], d[order], np.searchsorted(shard[order], np.arange(shards + 1))
            kept = struct.pack("<q", len(size)) + size.tobytes() + base.tobytes() + n_known.tobytes()
            out_s, out_b = [int(mix(np.array([block], U))[0]) % shards], [pack.compress(kept)]
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[s], cuts[s + 1]
                first = np.flatnonzero(np.concatenate([[True], d[a + 1 : b] != d[a : b - 1]]))
                who = d[a:b][first]
                n = np.diff(np.append(first, b - a))
                body = struct.pack("<qq", len(who), b - a) + packed_bytes(np.diff(who, prepend=0), 4) + packed_bytes(n, 4) + learn[who].tobytes() + packed_bytes(v[a:b], 8) + packed_bytes(w[a:b], 8) + packed_bytes(u[a:b], 6)
                out_s.append(s)
                out_b.append(pack.compress(body))
            of = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(of)] * len(out_s), pa.int32()), of, mask=pa.array([False] + [True] * (len(out_s) - 1)))
            return pa.RecordBatch.from_arrays([pa.array(out_s, pa.int32()), pa.array([block] * len(out_s), pa.int64()), pa.array(out_b, pa.binary()), lists], names=["shard", "block", "body", "ids"])

        base = 0
        for batch in batches:
            for part in slices(batch):
                words = Words(*utf8_parts(part.column(0)), SPACED)
                code, n = own.codes(words.h), words.n_docs
                cv = np.where(code > 0, code.astype(U), OTHER_V | (words.h >> U(8)))
                cw = np.where(code > 0, code.astype(U), OTHER_W + (words.h >> U(8)))
                # Every document has its words as contexts, with the start before and the end after them.
                size = words.count + 1
                v, w = np.full(len(words.h) + n, U(START)), np.full(len(words.h) + n, U(END))
                at = np.arange(len(words.h)) + words.d
                v[at + 1], w[at] = cv, cw
                cu = np.where(code > 0, code.astype(U), OTHER_U | (words.h >> U(24)))
                u, inner = np.full(len(v), U(START)), np.ones(len(words.h), bool)
                inner[words.first[1:][words.count > 0] - 1] = False
                u[at[inner] + 2] = cu[inner]
                sums = [np.bincount(words.d, np.where(code > 0, x[code], 0), n) + x[END] for x in (logs, known)]
                held.append((v, w, u, np.repeat(np.arange(n), size) + base, part.column(1).fill_null(False).to_numpy(zero_copy_only=False), size.astype(np.int64), sums[0], sums[1].astype(np.int64)))
                ids.append(part.column(2))
                base, n_held = base + n, n_held + len(v)
                if n_held >= BLOCK_EVENTS:
                    yield rows()
                    held, ids, n_held, base, block = [], [], 0, 0, block + 1
        if held:
            yield rows()
        release()

    fields = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))])
    return docs.select("text", "learn", "doc_id").mapInArrow(run, fields)


def _answers(uni, mu: float, k: float):
    """Answers to the events of a shard: for each block, score, base sum and known words of its documents, packed; what blocks keep goes on."""

    def run(table: pa.Table) -> pa.Table:
        own, unpack, pack = uni.value, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        kept, bodies = table.column("ids").is_valid().to_numpy(), table.column("body")
        asked = np.flatnonzero(~kept).tolist()
        out = {i: bodies[i].as_py() for i in np.flatnonzero(kept).tolist()}
        if asked:
            whos, *got = zip(*[_event_parts(unpack.decompress(bodies[i].as_py())) for i in asked], strict=True)
            size, learn, v, w, u = (np.concatenate(x) for x in got)
            del got
            order = np.lexsort((u, w, v))
            v, w, u = v[order], w[order], u[order]
            triple = _firsts(v, w, u)
            of = np.empty(len(order), np.int32)  # the distinct event of each
            of[order] = np.repeat(np.arange(len(triple), dtype=np.int32), np.diff(np.append(triple, len(order))))
            times = np.add.reduceat(np.repeat(learn, size)[order].astype(np.int64), triple)
            v, w, u = v[triple], w[triple], u[triple]
            del order
            pair = _firsts(v, w)
            of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(v))))
            learnt = times > 0
            shard = Shard(Shard.build(v[learnt], w[learnt], u[learnt], times[learnt], own, mu, k))
            v, w, p, c = v[pair], w[pair], np.empty(len(u)), np.empty(len(pair), np.int64)
            ends = np.append(pair, len(u))
            for a in range(0, len(pair), 1 << 17):
                b = min(a + (1 << 17), len(pair))
                some = slice(ends[a], ends[b])
                p[some], c[a:b] = shard.parts(v[a:b], w[a:b], u[some], of_pair[some] - a, own, mu, k)
            starts = np.cumsum(size) - size
            score = np.rint(np.add.reduceat(p[of], starts) * FINE).astype(np.int64)
            of, tail = of_pair[of], w >= OTHER_W
            base = np.add.reduceat(np.where(tail, np.log10(c + 1.0), 0)[of], starts)
            known = np.add.reduceat((tail & (c > 0)).astype(np.int32)[of], starts)
            cut = 0
            for i, who in zip(asked, whos, strict=True):
                n = len(who) // 4
                some = slice(cut, cut + n)
                cut += n
                less = base[some][known[some] > 0]
                out[i] = pack.compress(struct.pack("<qq", n, len(less)) + who + packed_bytes(score[some] << 1 ^ score[some] >> 63, 5) + packed_bytes(known[some], 4) + less.tobytes())
            del of, of_pair, p, c
        release()
        names = ["block", "ids"]
        return pa.table([*[table.column(x).combine_chunks() for x in names], pa.array([out[i] for i in range(table.num_rows)], pa.binary())], names=[*names, "body"])

    return run


def _event_parts(body: bytes) -> tuple:
    """Of the events of a block in a shard: packed steps between documents, then events of each, whether they train, and codes v, w, u."""
    docs, n = struct.unpack_from("<qq", body)
    b, at = memoryview(body), 16 + 9 * docs
    sizes = unpacked_bytes(b[16 + 4 * docs :], docs, 4).astype(np.int64)
    return bytes(b[16 : 16 + 4 * docs]), sizes, np.frombuffer(b, bool, docs, 16 + 8 * docs), unpacked_bytes(b[at:], n, 8), unpacked_bytes(b[at + 8 * n :], n, 8), unpacked_bytes(b[at + 16 * n :], n, 6)


def _added(fields: T.StructType, per_event: float, per_text: float):
    """The documents of a block with their sums over the shards."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        kept = table.column("ids").is_valid().to_numpy()
        (own,) = np.flatnonzero(kept)
        b = unpack.decompress(table.column("body")[int(own)].as_py())
        (n,) = struct.unpack_from("<q", b)
        size, base, known = (np.frombuffer(b, kind, n, 8 + 8 * n * i).copy() for i, kind in enumerate((np.int64, float, np.int64)))
        score = np.zeros(n, np.int64)
        for k in np.flatnonzero(~kept).tolist():
            b = memoryview(unpack.decompress(table.column("body")[k].as_py()))
            docs, less = struct.unpack_from("<qq", b)
            who = np.cumsum(unpacked_bytes(b[16:], docs, 4).astype(np.int64))
            z = unpacked_bytes(b[16 + 4 * docs :], docs, 5).astype(np.int64)
            score[who] += z >> 1 ^ -(z & 1)
            more = unpacked_bytes(b[16 + 9 * docs :], docs, 4).astype(np.int64)
            known[who] += more
            base[who[more > 0]] += np.frombuffer(b, float, less, 16 + 13 * docs)
        ids = table.column("ids").combine_chunks()
        ids = ids.flatten() if not isinstance(ids, pa.ChunkedArray) else pa.concat_arrays([x.flatten() for x in ids.chunks])
        return pa.table([ids, pa.array(size), pa.array(known), pa.array(base), pa.array(score / FINE + size * per_event + per_text)], names=fields.fieldNames())

    return run


def lm_scores(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, mu: float = MU, merge: float = MERGE, shard_events: int = SHARD_EVENTS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; learn is a condition on doc_id (the id's name here)."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("learn", learn)
    uni = unigrams(docs, head)
    shared = sc.broadcast(uni)  # head words at most
    shards = max(32, -(-uni.events // shard_events))
    answers = _events(docs, shared, shards).groupBy("shard").applyInArrow(_answers(shared, mu, merge), T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("body", T.BinaryType())]))
    fields = T.StructType([docs.schema["doc_id"], *[T.StructField(x, k) for x, k in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()))]])
    per_event, per_text = float(np.log10(merge * mu)), -float(np.log10(uni.docs + merge * (uni.docs + mu)))
    sums = answers.groupBy("block").applyInArrow(_added(fields, per_event, per_text), fields)
    floor = float(np.log10(uni.tokens + uni.types + 1.0))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(uni.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
