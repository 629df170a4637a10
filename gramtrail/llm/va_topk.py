"""Exact top-k by inner product with a vector-approximation file.

Vectors become integers, floor(scale * x), kept in a table of rows by place. Beside it lies the approximation file: blocks of ids, places and a cell
number of one byte for each component, without the vectors. For a query, the cell centres and the largest error of a cell bound every score.

Two scans of the cells, blocks of queries against blocks of vectors: the first finds, for each query, the kth highest lower
bound over all vectors, with its own bounds merged in two levels; the second keeps the places whose upper bound reaches it. Then exact vectors of these
places are read by falling upper bound, in growing steps, until no unread bound reaches the query's kth exact score.

Of equal vectors only the rows of the k + 1 smallest ids, and of each id k rows, can be among the best, so large groups of copies are cut
to these before anything is packed (each task cuts its own first).

Cases: vectors that are null or hold a null, NaN or infinite component, or one whose integer reaches 2**26 (beyond which scores could leave 64 bits), or
have a null id, take no part; vectors of another length than the query's are not compared with it; rows with the query's id are its own; equal
scores rank by the smaller id; repeated rows count each, and each row of an id that is asked is a query with k results of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, written

BLOCK, QUERY_BLOCK, CELLS, MOST = 4096, 1024, 64, 1 << 26
#: What the names of one length are split into before blocks of queries meet blocks of vectors.
SALTS = 64
PACKED = "dim int, places binary, ids binary, cells binary, low binary, width binary"
ASKED = "dim int, q_places binary, q_ids binary, q binary"
LIMITS = "q_block long, limits binary"
KEPT = T.StructType([T.StructField("q_place", T.LongType()), T.StructField("place", T.LongType()), T.StructField("upper", T.DoubleType())])


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id and x, the integer vector, of the rows that take part."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    fit = rows.where(F.col("vec_id").isNotNull() & F.forall("e", lambda v: F.coalesce(F.abs(v) * scale < MOST, F.lit(False))))
    return fit.select("vec_id", F.transform("e", lambda v: F.floor(v * scale)).alias("x"))


def eligible(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the best k of some query: of equal vectors k rows of each of the k + 1 smallest ids."""
    each = Window.partitionBy("x", "vec_id").orderBy("vec_id")
    some = rows.withColumn("n", F.row_number().over(each)).where(F.col("n") <= k)
    return some.withColumn("n", F.dense_rank().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, places, ids and vectors of at most so many rows of one length."""
    held: dict[int, list] = {}

    def whole(dim):
        return dim, *(np.concatenate(x) for x in zip(*held.pop(dim), strict=True))

    for batch in batches:
        place, key, x = batch.columns
        size = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, start = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        place, key = place.to_numpy(), key.to_numpy()
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            while len(at):
                room = most - sum(len(p) for p, *_ in held.get(dim, []))
                own, at = at[:room], at[room:]
                held.setdefault(dim, []).append((place[own], key[own], flat[start[own][:, None] + np.arange(dim)]))
                if len(own) == room:
                    yield whole(dim)
    for dim in list(held):
        yield whole(dim)


def approximation(data: DataFrame, most: int, cells: int = CELLS) -> DataFrame:
    """Blocks of places, ids and cell numbers, with the lower edge and width of the cells by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, place, key, x in _groups(batches, most):
            low = x.min(0)
            width = np.maximum(1, -(-(x.max(0) - low + 1) // cells))
            parts = [place, key, ((x - low) // width).astype(np.uint8), low, width]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["dim", "places", "ids", "cells", "low", "width"])

    return data.select("place", "vec_id", "x").mapInArrow(run, PACKED).withColumn("block", F.monotonically_increasing_id())


def asked_blocks(asked: DataFrame, most: int) -> DataFrame:
    """Blocks of query vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, place, key, x in _groups(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in (place, key, x)]], names=["dim", "q_places", "q_ids", "q"])

    return asked.select("q_place", "query_id", "q").mapInArrow(run, ASKED).withColumn("q_block", F.monotonically_increasing_id())


def _meet(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Each block of queries with each block of cells of the same length: first their numbers, spread by salt, then what they hold."""
    names = cells.select("block", "dim").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    every = asked.select("q_block", "dim").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return names.join(every, ["dim", "salt"]).select("q_block", "block").join(asked, "q_block").join(cells.drop("dim"), "block")


def bounds(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the cell centres, by query and vector, and how far the true ones may lie from them by query; a query's own rows have -inf."""
    approx = q.astype(float) @ (cells * width.astype(float) + low + (width - 1) / 2).T
    approx[q_ids[:, None] == ids[None, :]] = -np.inf
    reach = np.maximum(np.abs(low), np.abs(low + 256 * width))
    return approx, np.abs(q) @ ((width - 1) / 2) + 1e-9 * (np.abs(q) @ reach) + 1e-6


def _parts(batch: pa.RecordBatch, r: int) -> tuple:
    get = lambda name, kind=np.int64: np.frombuffer(batch.column(name)[r].as_py(), kind)
    dim, q_ids, ids = batch.column("dim")[r].as_py(), get("q_ids"), get("ids")
    return get("q_places"), get("places"), bounds(get("q").reshape(len(q_ids), dim), q_ids, ids, get("cells", np.uint8).reshape(len(ids), dim), get("low"), get("width"))


def _highest(x: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row, -inf where there are fewer."""
    x = np.pad(x, ((0, 0), (0, max(0, k - x.shape[1]))), constant_values=-np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k :]


def lower_bounds(pairs: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """q_block and the kth highest lower bound of each of its queries over all vectors (-inf if there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, _, (approx, slack) = _parts(batch, r)
                yield pa.RecordBatch.from_arrays([batch.column("q_block").slice(r, 1), batch.column("block").slice(r, 1), pa.array([_highest(approx - slack[:, None], k).tobytes()], pa.binary())], names=["q_block", "block", "limits"])

    def merged(last: bool):
        def run(table: pa.Table) -> pa.Table:
            best = None
            for body in table.column("limits"):
                x = np.frombuffer(body.as_py(), float).reshape(-1, k)
                best = x if best is None else _highest(np.hstack([best, x]), k)
            body = best.min(1) if last else best
            return pa.table([table.column("q_block").combine_chunks().slice(0, 1), pa.array([body.tobytes()], pa.binary())], names=["q_block", "limits"])

        return run

    each = pairs.mapInArrow(run, "q_block long, block long, limits binary")
    part = F.pmod(F.xxhash64("block"), F.lit(max(1, math.isqrt(n_blocks))))  # as many messages in each level
    return each.groupBy("q_block", part.alias("part")).applyInArrow(merged(False), LIMITS).groupBy("q_block").applyInArrow(merged(True), LIMITS)


def survivors(pairs: DataFrame) -> DataFrame:
    """q_place, place and upper bound of the vectors whose upper bound reaches the limit of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_places, places, (approx, slack) = _parts(batch, r)
                upper = approx + slack[:, None]
                limit = np.frombuffer(batch.column("limits")[r].as_py(), float)
                i, j = np.nonzero((upper >= limit[:, None]) & np.isfinite(upper))
                for a in range(0, len(i), 1 << 17):
                    b = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(q_places[i[b]]), pa.array(places[j[b]]), pa.array(upper[i[b], j[b]])], names=KEPT.fieldNames())

    return pairs.mapInArrow(run, KEPT)


def top_k(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, scale: float = 64.0, block: int = BLOCK, query_block: int = QUERY_BLOCK, cells: int = CELLS, reads: list | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each query; queries is a condition on vec_id (the id's name here).

    reads, if given, takes the number of exact vectors read in each step.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, vec_id, embedding, scale)
    data = written(eligible(rows, k).withColumn("place", F.monotonically_increasing_id()), "va-vectors")
    asked = written(rows.where(queries).select(F.monotonically_increasing_id().alias("q_place"), F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "va-queries")
    file, packed = written(approximation(data, block, cells), "va-cells"), written(asked_blocks(asked, query_block), "va-asked")
    limits = written(lower_bounds(_meet(packed, file), file.count(), k), "va-limits")
    by_bound = Window.partitionBy("q_place").orderBy(F.desc("upper"), "place")
    found = written(survivors(_meet(packed.join(limits, "q_block"), file)).withColumn("turn", F.row_number().over(by_bound)), "va-survivors")
    most = found.agg(F.max("turn")).first()[0] or 0
    by_score = Window.partitionBy("q_place").orderBy(F.desc("score"), "vec_id")
    score = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
    best, at, to = None, 0, 2 * k
    while best is None or at < most:
        turn = found.where((F.col("turn") > at) & (F.col("turn") <= to))
        if best is not None:  # a query that has its kth score needs no bound below it
            turn = turn.join(best.where(F.col("rank") == k).select("q_place", F.col("score").alias("kth")), "q_place", "left").where("kth IS NULL OR upper >= kth")
        step = written(turn.join(data, "place").join(asked, "q_place").select("q_place", "query_id", "vec_id", score.alias("score")), "va-read")
        n = step.count()
        if reads is not None:
            reads.append(n)
        if best is not None and not n:
            break  # the bounds of later turns are lower still
        old = [] if best is None else [best]
        every = step if best is None else best.drop("rank").unionByName(step)
        best = written(every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "va-best")
        for t in [step, *old]:
            drop(spark, t)
        at, to = to, 4 * to
    for t in (data, asked, file, packed, limits, found):
        drop(spark, t)
    return best.select("query_id", "rank", "vec_id", "score")
