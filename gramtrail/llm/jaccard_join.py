"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of hashed word shingles. Documents with one set form a class; classes are joined. The global
order of shingles is by the number of classes that have them, rarest first, then by hash. Two sets x and y, x the
smaller, of similarity t or more have an overlap of even(x) = 2t/(1+t) |x| and of need(y) = t |y| at least, so for
any m they share at least m of the first |x| - even(x) + m shingles of x and the first |y| - need(y) + m of y. Shingles
of one class alone come first and are shared with none, hence need no index. Each class lengthens its prefix to the m
(up to MOST) with the least estimated cost: the entries that its prefix meets, and the partners that share m of them and
must be verified. All classes are indexed with the level from which on an entry counts, so that a pair is counted at
the m of its smaller class; what it shares must then still be able to reach the least overlap.

The counts come by a question and an answer. Blocks of classes send their shingles to buckets by range, sorted and packed,
those of several classes of the block as one number, so that a shingle adds at most three entries a block to its bucket;
the buckets return those that more than one class has. A class with fewer of these than its least overlap has no partner.
Whole overlaps are counted on the shingles that are shared at all.

Before the prefixes meet, each class is compared with two hubs, the classes that its shingles have in common with most
others; a quarter of the shingles of a class of 64 or more, by hash, decides which. This only saves work: classes found linked are
one component, and a shingle that no two components have is not indexed. So thousands of near copies cost a pair each and
not their square. A shingle's entries are split into those of one component and the rest, and the members of that component
meet the rest alone.

Cases: a null or wordless text has an empty set and no link; with fewer words than a shingle the whole sequence is
its one shingle; rows with one id and other texts are separate; repeated rows get a row each; a row without an id
takes the component of a row with the same shingles and an id, else none (null); an empty table gives no rows; other columns, whatever
their names, are left out. Texts of any length are read whole; a block holds a whole set at least.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import drop, written
from .textops import SPACED, U, Words, free_name, grams, map_docs, mix, packed_bytes, release, slices, unpacked_bytes, utf8_parts

WORDS, PERCENT = 5, 80
#: Most matches that a class asks for, and the cost of a verified pair in met entries.
MOST, VERIFY = 4, 20
#: Shingles of a block and, on average, of a bucket; from so many classes of a block on a shingle goes as a number.
BLOCK, BUCKET, SEVERAL = 750_000, 1_000_000, 4
BROADCAST_ROWS = 1_000_000
_ASK, _KEEP = 0, 1


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity in per cent, and the least overlaps that follow."""

    words: int = WORDS
    percent: int = PERCENT

    def need(self, n):
        """Least overlap of a set of n with any partner."""
        return -(-self.percent * n // 100)

    def even(self, n):
        """Least overlap of a set of n with a partner that is no smaller."""
        return -(-2 * self.percent * n // (100 + self.percent))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each document of a chunk."""
    g, good = grams(words.h, words.d, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(words.h[a:b], np.zeros(b - a, int), b - a)[0])
        else:
            out.append(np.zeros(0, U))
    return out


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _small(rows: DataFrame) -> DataFrame:
    """The rows, marked for broadcast where there are at most BROADCAST_ROWS of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed."""
    parts = [x.tobytes() if isinstance(x, np.ndarray) else x for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<q", len(b)) + b for b in parts))


def _get(body, *kinds) -> list[np.ndarray]:
    view, at, out = memoryview(zstandard.ZstdDecompressor().decompress(body)), 0, []
    for kind in kinds:
        (size,) = struct.unpack_from("<q", view, at)
        out.append(np.frombuffer(view, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _steps(rising: np.ndarray) -> bytes:
    """Rising numbers by their differences, in as many bytes as the largest takes."""
    d = np.diff(rising.astype(U), prepend=U(0))
    size = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    return struct.pack("<qqB", len(d), int(d[0]) if len(d) else 0, size) + packed_bytes(d[1:], size)


def _from_steps(b: np.ndarray) -> np.ndarray:
    n, first, size = struct.unpack_from("<qqB", b)
    return np.cumsum(np.concatenate([np.array([first], U), unpacked_bytes(b[17:], n - 1, size)])).astype(U) if n else np.zeros(0, U)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _asks(found: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """The questions of blocks of classes, and what a block keeps: its classes, and where its common shingles are."""

    def block(number: int, sets: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.uint32)
        token, who = np.concatenate(sets) >> U(16), np.repeat(np.arange(len(sets)), n).astype(np.uint16)
        order = np.argsort(token, kind="stable")
        token, who = token[order], who[order]
        first, times = _runs(token)
        several = np.repeat(times >= SEVERAL, times)
        common, common_n = token[first[times >= SEVERAL]], times[times >= SEVERAL].astype(np.uint32)
        own, own_who = token[~several], who[~several]
        edge = (np.arange(buckets + 1).astype(object) * (1 << 48) // buckets).astype(U)
        a, b = np.searchsorted(own, edge), np.searchsorted(common, edge)
        to, kind, body = [], [], []
        for k in range(buckets):
            if a[k] < a[k + 1] or b[k] < b[k + 1]:
                to.append(k)
                kind.append(_ASK)
                body.append(_put(_steps(own[a[k] : a[k + 1]]), own_who[a[k] : a[k + 1]], _steps(common[b[k] : b[k + 1]]), common_n[b[k] : b[k + 1]]))
        to.append(int(mix(np.array([number], U))[0]) % buckets)
        kind.append(_KEEP)
        body.append(_put(np.array(classes, np.int64), n, _steps(common), common_n, who[several]))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([number] * len(to), pa.int64()), pa.array(kind, pa.int8()), pa.array(body, pa.binary())], names=["bucket", "block", "kind", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, sets, classes, held = TaskContext.get().partitionId() << 20, [], [], 0
        for batch in batches:
            for part in slices(batch):
                for s, c in zip(shingle_sets(Words(*utf8_parts(part.column(0)), SPACED), rule.words), part.column(1).to_pylist(), strict=True):
                    if class_of(s) == c:  # else a row that shares only the id
                        sets.append(s)
                        classes.append(c)
                        held += len(s)
                        if held >= BLOCK or len(sets) == 1 << 16:
                            yield block(number, sets, classes)
                            number, sets, classes, held = number + 1, [], [], 0
        if sets:
            yield block(number, sets, classes)
        release()

    return found.select("text", "c").mapInArrow(run, "bucket int, block long, kind byte, body binary")


def _bucket(table: pa.Table) -> pa.Table:
    """For each block its shingles that more than one class has, with how many have them; what blocks keep goes on."""
    kinds, blocks, bodies = (table.column(x).to_pylist() for x in ("kind", "block", "body"))
    asked = [i for i, k in enumerate(kinds) if k == _ASK]
    out = [(blocks[i], _KEEP, bodies[i]) for i, k in enumerate(kinds) if k == _KEEP]
    got = []
    for i in asked:
        own, who, common, times = _get(bodies[i], np.uint8, np.uint16, np.uint8, np.uint32)
        got.append((_from_steps(own), who, _from_steps(common), times))
        bodies[i] = None
    if got:
        tokens = np.concatenate([x for own, _, common, _ in got for x in (own, common)])
        order = np.argsort(tokens, kind="stable")
        first, run = _runs(tokens[order])
        del tokens
        weight = np.concatenate([x for own, _, _, times in got for x in (np.ones(len(own), np.uint32), times)])
        total = np.empty(len(order), np.uint32)
        total[order] = np.repeat(np.minimum(np.add.reduceat(weight[order].astype(np.int64), first), (1 << 32) - 1), run) if len(order) else 0
        at = 0
        for i, (own, who, common, _) in zip(asked, got, strict=True):
            mine, theirs = total[at : at + len(own)], total[at + len(own) : at + len(own) + len(common)]
            at += len(own) + len(common)
            out.append((blocks[i], _ASK, _put(_steps(own[mine > 1]), who[mine > 1], mine[mine > 1], _steps(common), theirs)))
    block, kind, body = zip(*out, strict=True)
    release()
    return pa.table([pa.array(block, pa.int64()), pa.array(kind, pa.int8()), pa.array(body, pa.binary())], names=["block", "kind", "body"])


_ALIVE = T.StructType([T.StructField("num", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("costs", T.ArrayType(T.LongType()))])


def _lists(arrays: list, kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)), pa.array(flat, kind))


def _alive(rule: Rule):
    """Of a block, the classes that share enough to have a partner: number, class, size, costs of all shingles by size, shared shingles and their costs, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(x).to_pylist() for x in ("block", "kind", "body")], strict=True))
        number = rows[0][0]
        keep = next(body for _, kind, body in rows if kind == _KEEP)
        classes, n, common, times, common_who = _get(keep, np.int64, np.uint32, np.uint8, np.uint32, np.uint16)
        common = _from_steps(common)
        parts = [[np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        total = np.zeros(len(common), np.int64)
        for _, kind, body in rows:
            if kind == _ASK:
                own, who, cost, theirs, its = _get(body, np.uint8, np.uint16, np.uint32, np.uint8, np.uint32)
                total[np.searchsorted(common, _from_steps(theirs))] = its
                for x, y in zip(parts, (_from_steps(own), who, cost), strict=True):
                    x.append(y)
        token = np.concatenate([*parts[0], np.repeat(common, times)])
        who = np.concatenate([*[x.astype(np.int64) for x in parts[1]], common_who.astype(np.int64)])
        cost = np.concatenate([*[x.astype(np.int64) for x in parts[2]], np.repeat(total, times)])
        enough = np.bincount(who, minlength=len(n)) >= rule.need(n.astype(np.int64))
        score = np.bincount(who, cost, len(n)) / np.maximum(n, 1)
        some = enough[who]
        token, who, cost = token[some], who[some], cost[some]
        order = np.lexsort((token, cost, who))
        token, who, cost = token[order].view(np.int64), who[order], cost[order]
        at = np.flatnonzero(enough)
        cuts = np.searchsorted(who, np.append(at, len(n)))
        return pa.table([
            pa.array((number << 16) + at, pa.int64()), pa.array(classes[at]), pa.array(n[at].astype(np.int64)), pa.array(score[at]),
            *[_lists([x[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()) for x in (token, cost)],
        ], names=_ALIVE.fieldNames())

    return run


def plan(n: int, cost: np.ndarray, rule: Rule) -> int:
    """The number of matches m that a class of n shingles asks for; cost are the classes of its shared shingles, rarest first."""
    short = len(cost) - int(rule.even(n))  # shared shingles in the prefix for no match
    met = [int(cost[: max(0, short + m)].sum()) for m in range(1, max(1, min(MOST, int(rule.need(n)))) + 1)]
    return 1 + int(np.argmin([x + VERIFY * min(met[0], x / m) for m, x in enumerate(met, 1)]))


def _entries(alive: DataFrame, rule: Rule) -> DataFrame:
    """Index entries: class num of component comp, n shingles of which s are shared, m; a token at place j among them, the level from which it counts, and whether the class asks with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for num, comp, n, tokens, costs in zip(*batch.columns, strict=True):
                num, comp, n = num.as_py(), comp.as_py(), n.as_py()
                token, cost = tokens.values.to_numpy(), costs.values.to_numpy()
                s, m = len(token), plan(n, cost, rule)
                j = np.arange(s)
                level = np.maximum(1, j + (n - s) - (n - int(rule.need(n))) + 1)
                few = min(MOST, int(rule.need(n)))
                inside = level <= few
                asks = (j + (n - s) < n - int(rule.even(n)) + m) & (s >= rule.even(n))
                k = int(inside.sum())
                held.append([*[np.full(k, x, np.int64) for x in (num, comp, n, s, m)], token[inside], j[inside], level[inside], asks[inside]])
                size += k
                if size > 200_000:
                    yield entries(held)
                    held, size = [], 0
            if held:
                yield entries(held)

    def entries(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["num", "comp", "n", "s", "m", "token", "j", "level", "asks"])

    return alive.select("num", "comp", "n", "tokens", "costs").mapInArrow(run, "num long, comp long, n long, s long, m long, token long, j long, level long, asks boolean")


def _linked(alive: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of class numbers that are similar enough, as u and v; the shingles of b travel once a pair, those of a once."""
    pairs = written(pairs.select("a", "b"), "join-pairs")
    sets = alive.select("num", "n", "tokens")
    two = _small(pairs).join(sets.withColumnsRenamed({"num": "b", "n": "n2", "tokens": "y"}), "b")
    one = sets.join(_small(pairs.select("a").distinct()), F.col("num") == F.col("a")).select("a", "n", F.col("tokens").alias("x"))
    both = F.size(F.array_intersect("x", "y"))
    return two.join(one, "a").where(100 * both >= rule.percent * (F.col("n") + F.col("n2") - both)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _alike(rule: Rule):
    return 100 * F.least("n", "n2") >= rule.percent * F.greatest("n", "n2")


def _hub_pairs(alive: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of each class with two hubs of its shingles."""
    token = F.explode(F.when(F.col("n") < 64, F.col("tokens")).otherwise(F.filter("tokens", lambda t: t % 4 == 0))).alias("token")
    rows = alive.select("num", "n", "score", token)
    hubs = rows.groupBy("token").agg(F.max(F.struct("score", "num", "n")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    meets = rows.select("num", "n", "token").join(hubs.select("token", F.col("hub.num").alias("d"), F.col("hub.n").alias("n2")), "token").where(F.col("num") != F.col("d")).where(_alike(rule))
    meets = meets.groupBy("num", "d").agg(F.count("*").alias("k"))
    first = Window.partitionBy("num").orderBy(F.desc("k"), "d")  # hubs of one class
    return meets.withColumn("i", F.row_number().over(first)).where("i <= 2").select(F.col("d").alias("a"), F.col("num").alias("b"))


def _prefix_pairs(alive: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of classes of different components that share as many prefix shingles as the smaller asks for."""
    rows = _entries(alive, rule)
    spread = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("s", "comp")).alias("main")).where("lo < hi").select("token", F.col("main.comp").alias("main"))
    live = written(rows.join(spread, "token"), "join-index")
    inside = F.col("comp") == F.col("main")
    index = live.select("token", inside.cast("int").alias("side"), *[F.col(x).alias(f"{x}2") for x in ("num", "comp", "n", "s", "j", "level")])
    asks = live.where("asks").select("token", F.explode(F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"), "num", "comp", "n", "s", "j", "m")
    reach = lambda most: (100 + rule.percent) * most >= rule.percent * (F.col("n") + F.col("n2"))
    behind = F.least(F.col("s") - 1 - F.col("j"), F.col("s2") - 1 - F.col("j2"))
    fits = F.expr("comp <> comp2 AND (n < n2 OR n = n2 AND num < num2) AND level2 <= m") & _alike(rule) & reach(F.least("s", "s2")) & reach(F.least("j", "j2") + 1 + behind)
    pairs = asks.join(index, (asks["token"] == index["token"]) & (asks["side"] == index["side"]) & fits)
    both = pairs.groupBy("num", "num2", "n", "n2", "s", "s2", "m").agg(F.count("*").alias("both"), F.max("j").alias("j"), F.max("j2").alias("j2"))
    return both.where("both >= m").where(reach(F.col("both") + behind)).select(F.col("num2").alias("a"), F.col("num").alias("b"))


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row; classes are sets of shingles."""
    rule = Rule(words, percent)
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def make():
        def each(texts, _):
            sets = shingle_sets(Words(*utf8_parts(texts), SPACED), rule.words)
            return [np.array([len(s) for s in sets], np.int64), np.array([class_of(s) for s in sets], np.int64)]

        return each

    rows = written(map_docs(docs, "text", ["doc_id"], T.StructType([T.StructField("n", T.LongType()), T.StructField("c", T.LongType())]), make), "join-rows")
    same = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("c", "doc_id").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    classes = same.groupBy("c").agg(F.min(F.struct("doc_id", "k")).alias("least"), F.first("n").alias("n")).select("c", F.col("least.doc_id").alias("rep"), F.col("least.k").alias("k"), "n")
    classes = written(classes, "join-classes")
    total, repeats = classes.agg(F.sum("n"), F.max("k")).first()
    if not total:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"), F.col("c").alias("class_id"))

    found = docs.join(_small(classes.select("c", "rep", "k")), F.col("doc_id") == F.col("rep"))
    if repeats > 1:  # rows with one id and text: one of them is enough
        found = found.where("k = 1").union(found.where("k > 1").dropDuplicates(["c", "rep", "text"]))
    asks = _asks(found, rule, max(32, -(-total // BUCKET)))
    answers = asks.groupBy("bucket").applyInArrow(_bucket, "block long, kind byte, body binary")
    alive = written(answers.groupBy("block").applyInArrow(_alive(rule), _ALIVE), "join-alive")

    near = written(_linked(alive, _hub_pairs(alive, rule), rule), "join-near")
    roots = components(near, most=2)  # what is not yet one component there is found again
    parts = alive.join(roots, F.col("num") == F.col("node"), "left").select("num", F.coalesce("root", "num").alias("comp"), "n", "tokens", "costs")
    links = written(_linked(alive, _prefix_pairs(parts, rule), rule), "join-links")

    final = components(near.union(links))
    named = alive.select("num", "c").join(final, F.col("num") == F.col("node"), "left").select("c", F.coalesce("root", "num").alias("root"))
    named = named.join(classes.select("c", "rep"), "c")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    known = written(named.join(least, "root").groupBy("c").agg(F.min("least").alias("least")), "join-known")
    for x in (alive, near, links):
        drop(docs.sparkSession, x)
    every = classes.join(known, "c", "left").select("c", F.coalesce("least", "rep").alias("component_id"))
    return rows.join(every, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("c").alias("class_id"))


def one_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of one document of each component, the one with the least id; without words or id rows stay."""
    found = written(join(docs, doc_id=doc_id, text=text, words=words, percent=percent), "join-found")
    kept = written(found.where("doc_id = component_id AND n_shingles > 0").groupBy("class_id", "doc_id").agg(F.count("*").alias("copies")), "join-kept")
    mark, own_id = free_name("__class", docs.columns), free_name("__id", docs.columns)

    def make():
        def each(texts, _):
            sets = shingle_sets(Words(*utf8_parts(texts), SPACED), words)
            return [pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())]

        return each

    rows = map_docs(docs, text, docs.columns, T.StructType([T.StructField(mark, T.LongType())]), make)
    free = F.col(mark).isNull() | F.col(f"`{doc_id}`").isNull()
    own = [F.col(f"`{c}`") for c in docs.columns]
    stay = rows.join(_small(kept.select(F.col("class_id").alias(mark), F.col("doc_id").alias(own_id))), mark).where(F.col(f"`{doc_id}`") == F.col(own_id))
    if kept.where("copies > 1").limit(1).count():  # an id that comes more than once with one text
        stay = stay.dropDuplicates([mark, own_id])
    return stay.select(*own).unionByName(rows.where(free).select(*own))
