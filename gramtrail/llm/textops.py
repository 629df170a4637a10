"""Whole-batch text primitives: byte tables, word boundaries and 64-bit word hashes in numpy.

A chunk of texts is one uint8 array with document offsets, as Arrow keeps it, so that no
Python loop runs over words. Hashes are polynomial over a random byte table, mixed; they
depend on the bytes alone, hence agree between machines and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20


def release() -> None:
    """Give memory that is free back to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python 4 MB at a time: neither side then holds 64 MB, and twice that while it grows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, None) or BATCH_BYTES + 1) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U) * U(0xD1342543DE82EF95) + U(7))
_BASE = 0x5851F42D4C957F2D | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

_all = np.arange(256)
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: Words between ASCII white space.
SPACED = ~np.isin(_all, [32, *range(9, 14)])
#: Words of digits, a-z and whatever is not ASCII (after lower-casing).
ALNUM = ((_all >= 48) & (_all <= 57)) | ((_all >= 97) & (_all <= 122)) | (_all >= 128)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW


class Words:
    """Words of a chunk: hash h, document d, and byte range start, end of each word; first[i] is the first word of document i. fold takes A-Z as a-z."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool = True):
        n = len(data)
        self.n_docs = len(offsets) - 1
        low = LOWER[data] if fold else data
        m = is_word[low]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, m[:-1]
            after[-1], after[:-1] = False, m[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        p, inv = _powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[low] * p[:n], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inv[self.start]
        self.h = mix(h + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, offsets)
        self.d = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.count = np.diff(self.first)


def grams(h: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they are of one document (the arrays are k-1 shorter than h)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    out = np.full(n, U(int(k) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    for j in range(k):
        out = out * U(0xF1357AEA2E62A9C5) + h[j : j + n]
    return mix(out), d[k - 1 :] == d[:n]


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def packed_bytes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of numbers, byte by byte."""
    return np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpacked_bytes(b, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8, n * size).reshape(size, n).T
    return out.reshape(-1).view(U)


def slices(batch: pa.RecordBatch, column: int = 0, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes of text; a longer text is a run of its own."""
    texts = batch.column(column)
    sizes = np.diff(utf8_parts(texts)[1])
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def map_docs(df: DataFrame, text: str, keep: Iterable[str], fields: T.StructType, make: Callable[[], Callable[[pa.Array, pa.RecordBatch], list]]) -> DataFrame:
    """Add columns that a function computes from whole texts, chunk by chunk, to the kept columns.

    make() gives the function, once per task; it gets the texts and the chunk (text first, then
    the kept columns) and returns an array per field. A kept column whose name is also
    that of a field gives way to it.
    """
    small_batches(df.sparkSession)
    keep = [c for c in dict.fromkeys(keep) if c not in fields.fieldNames()]
    same = text in keep and isinstance(df.schema[text].dataType, T.StringType)  # the text goes to Python once
    mine = free_name("__text", keep)
    rows = df.select(F.col(f"`{text}`").cast("string").alias(mine), *[F.col(f"`{c}`") for c in keep if not (same and c == text)])
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch):
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in each(part.column(0), part)]
                old = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                yield pa.RecordBatch.from_arrays([*[old[mine if same and c == text else c] for c in keep], *new], names=names)
        release()

    return rows.mapInArrow(run, schema)


def free_name(name: str, columns: Iterable[str]) -> str:
    """The name, longer where one of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int):
    """crc32 of an id as decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
