"""Corpora in the stored forms of earlier programs: one binary file each, read by the executors.

A file is a mark, a version and a JSON body. Versions 1 to 3 keep tokens as gzip of lines, version 4 as gzip of numbers into a lexicon;
positions by token are JSON lists in versions 1 and 2 and base64 of portable bitmaps in 3 and 4; version 4 may name the source files.
Cases: a body without tokens is read from its positions, and without either is empty; a file that cannot be read has no rows, and problems() says why.
"""

from __future__ import annotations

import base64
import gzip
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.corpus import Corpus, prefix_sums
from .scratch import ranked

#: How a stored file begins, its versions, and how a portable bitmap begins without and with runs.
MAGIC, VERSIONS = b"VIBE", (1, 2, 3, 4)
PLAIN, RUNS = 12346, 12347
#: Rows of a batch that a decoder gives, and bytes of one that an encoder gives.
ROWS, BYTES = 1 << 16, 4 << 20


def bitmap_positions(data: bytes) -> np.ndarray:
    """The numbers of a portable bitmap: containers of 65,536 as sorted numbers, bits or runs."""
    cookie = struct.unpack_from("<I", data)[0]
    if cookie & 0xFFFF == RUNS:
        n, at = (cookie >> 16) + 1, 4
        is_run = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif cookie == PLAIN:
        n, at = struct.unpack_from("<I", data, 4)[0], 8
        is_run = np.zeros(n, bool)
    else:
        raise ValueError(f"no bitmap begins with {cookie}")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if not is_run.any() or n >= 4:  # places of the containers, which follow in order
        at += 4 * n
    out = []
    for (key, less), run in zip(heads, is_run, strict=True):
        if run:
            k = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            at += 2 + 4 * k
            values = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs]) if k else np.zeros(0, np.int64)
        elif less + 1 <= 4096:
            values = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            values = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append(values + (key << 16))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def bitmap_of(positions: np.ndarray) -> bytes:
    """A portable bitmap of sorted numbers, without runs."""
    n = len(positions)
    if 0 < n <= 4096 and positions[-1] < 1 << 16:  # one container of numbers, as nearly every word of a document has
        return struct.pack("<IIHHI", PLAIN, 1, 0, n - 1, 16) + positions.astype("<u2").tobytes()
    keys, first = np.unique(positions >> 16, return_index=True)
    parts = np.split(positions & 0xFFFF, first[1:]) if len(keys) else []
    heads, bodies = b"", []
    for key, low in zip(keys.tolist(), parts, strict=True):
        heads += struct.pack("<HH", key, len(low) - 1)
        if len(low) <= 4096:
            bodies.append(low.astype("<u2").tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    start = 8 + len(keys) * 8
    places = np.cumsum([0, *[len(b) for b in bodies]])[:-1] + start
    return struct.pack("<II", PLAIN, len(keys)) + heads + places.astype("<u4").tobytes() + b"".join(bodies)


class Stored:
    """What one stored file holds."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("the mark of a stored corpus is missing")
        self.version = struct.unpack_from("<I", data, 4)[0]
        if self.version not in VERSIONS:
            raise ValueError(f"version {self.version} is not known")
        self.body = json.loads(data[8:])

    def tokens(self) -> list[str]:
        """The tokens in order of position."""
        packed = self.body.get("compressed_tokens")
        if packed is None:
            return self._from_positions()
        raw = gzip.decompress(bytes(packed))
        if self.version < 4:
            return [t for t in raw.decode().split("\n") if t]
        names = self.body.get("lexicon") or []
        count = struct.unpack_from("<Q", raw)[0]
        return [names[i] for i in np.frombuffer(raw, "<u4", count, 8).tolist()]

    def positions(self, only: frozenset[str] | None = None) -> Iterator[tuple[str, np.ndarray]]:
        """Each token, or each of those named, with its positions; others are not decoded."""
        names = self.body.get("lexicon") or []
        for key, value in (self.body.get("token_positions") or {}).items():
            if only is not None and (names[int(key)] if self.version > 3 else key) not in only:
                continue
            at = bitmap_positions(base64.b64decode(value)) if self.version > 2 else np.array(json.loads(value), np.int64)
            yield (names[int(key)] if self.version > 3 else key), at

    def _from_positions(self) -> list[str]:
        found = sorted((p, t) for t, at in self.positions() for p in at.tolist())
        return [t for _, t in found]

    def files(self) -> list[tuple[str, str, int, int]]:
        """path, content, token_start and token_end of the source files."""
        return [(f["path"], f["content"], f["token_start"], f["token_end"]) for f in (self.body.get("file_index") or {}).get("files", [])]


def _each(files: DataFrame, schema: str, rows: Callable[[Stored], Iterator[tuple[list, ...]]]) -> DataFrame:
    """path (of the stored file) and the columns that a function gives in batches for each file."""
    whole = f"path string, {schema}"
    types = files.sparkSession.createDataFrame([], whole).schema
    names = types.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = list(rows(Stored(content.as_py() or b"")))
                except (ValueError, KeyError, IndexError, TypeError, OSError, EOFError, struct.error):  # problems() tells of it
                    continue
                for columns in own:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0]), pa.string()), *[pa.array(c) for c in columns]], names=names)

    return files.select("path", "content").mapInArrow(run, whole)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of stored files; a task reads whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def token_rows(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """path, token and pos (from 0 in each stored file) of files(path, content); of the tokens named alone, if any are."""
    named = None if only is None else frozenset(only)

    def rows(own: Stored) -> Iterator[tuple[list, ...]]:
        tokens = own.tokens()
        at = np.arange(len(tokens)) if named is None else np.array([i for i, t in enumerate(tokens) if t in named], np.int64)
        tokens = tokens if named is None else [tokens[i] for i in at.tolist()]
        for a in range(0, len(tokens), ROWS):
            yield pa.array(tokens[a : a + ROWS], pa.string()), at[a : a + ROWS]

    return _each(files, "token string, pos long", rows)


def posting_rows(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """path, token and pos by the stored positions, which need not be read for anything else: they let a file be checked. only names tokens; others give no rows."""
    named = None if only is None else frozenset(only)

    def rows(own: Stored) -> Iterator[tuple[list, ...]]:
        for token, at in own.positions(named):
            for a in range(0, len(at), ROWS):
                yield pa.array([token] * len(at[a : a + ROWS]), pa.string()), at[a : a + ROWS].astype(np.int64)

    return _each(files, "token string, pos long", rows)


def member_rows(files: DataFrame) -> DataFrame:
    """path, file, content, token_start and token_end of the source files that stored files name."""

    def rows(own: Stored) -> Iterator[tuple[list, ...]]:
        members = own.files()
        if members:
            yield tuple(pa.array([m[i] for m in members], pa.string() if i < 2 else pa.int64()) for i in range(4))

    return _each(files, "file string, content string, token_start long, token_end long", rows)


def problems(files: DataFrame) -> DataFrame:
    """path and problem of each stored file that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = Stored(content.as_py() or b"")
                    own.tokens(), own.files(), list(own.positions())
                except (ValueError, KeyError, IndexError, TypeError, OSError, EOFError, struct.error) as error:
                    bad.append((path, f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in bad], pa.string()) for i in range(2)], names=["path", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, problem string")


def corpus(files: DataFrame) -> Corpus:
    """One corpus of all stored files, in the order of their paths: positions run on from one to the next.

    Source files keep their ranges; tokens outside all of them, as those of versions 1 to 3, belong to no file.
    """
    rows = token_rows(files)
    sizes = files.select("path").join(rows.groupBy("path").agg(F.count("*").alias("n")), "path", "left").na.fill(0, ["n"])
    order = ranked(sizes, "path")
    starts = prefix_sums(order, "rank", "n", "start").select("path", "rank", "start")
    members = member_rows(files).join(starts, "path")
    numbers = ranked(members.select("rank", F.col("token_start").alias("begin"), "file", "content", "token_end", "start"), "rank", "begin", "file", name="doc_id")
    own = numbers.select("doc_id", F.col("file").alias("path"), "content", (F.col("start") + F.col("begin")).alias("token_start"), (F.col("start") + F.col("token_end")).alias("token_end"), (F.col("token_end") - F.col("begin")).alias("token_count"))
    lined = own.where("token_count > 0").select("doc_id", "token_start", F.posexplode(X.tokens_with_lines(F.col("content"))).alias("local_pos", "t")).select("doc_id", (F.col("token_start") + F.col("local_pos")).alias("pos"), "local_pos", F.col("t.line_no").alias("line_no"))
    placed = rows.join(starts, "path").select("token", (F.col("start") + F.col("pos")).alias("pos"))
    tokens = placed.join(lined, "pos", "left").select("token", "pos", "doc_id", "local_pos", "line_no")
    return Corpus(own, tokens)


def load_stored(spark: SparkSession, path: str, pattern: str = "*") -> Corpus:
    """A corpus of the stored files of a folder, or of one file."""
    return corpus(binary_files(spark, path, pattern))


def packed(version: int, tokens: list[str], files: list[dict] | None = None) -> bytes:
    """A stored file of one version."""
    names = list(dict.fromkeys(tokens))
    number = {t: i for i, t in enumerate(names)}
    ids = np.array([number[t] for t in tokens], np.int64)
    # One stable sort gives the places of every token in order; a pass for each token would grow with the square of a document.
    places = np.split(np.argsort(ids, kind="stable"), np.cumsum(np.bincount(ids))[:-1]) if len(ids) else []
    keep = (lambda p: json.dumps(p.tolist())) if version < 3 else (lambda p: base64.b64encode(bitmap_of(p)).decode())
    raw = struct.pack("<Q", len(ids)) + ids.astype("<u4").tobytes() if version == 4 else "\n".join(tokens).encode()
    body = {"version": version, "total_tokens": len(tokens), "compressed_tokens": list(gzip.compress(raw, mtime=0)), "token_positions": {str(i) if version == 4 else t: keep(p) for i, (t, p) in enumerate(zip(names, places, strict=True))}}
    if version == 4:
        body |= {"lexicon": names, "file_index": {"files": files or []}}
    return MAGIC + struct.pack("<I", version) + json.dumps(body).encode()


def encoded(rows: DataFrame, version: int) -> DataFrame:
    """path and content of stored files of one version, from rows(path, tokens, files): an array of tokens, and of structs path, content, token_start and token_end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, bodies, size = [], [], 0
            for i in range(batch.num_rows):
                path, tokens, files = (batch.column(c)[i].as_py() for c in range(3))
                paths.append(path)
                bodies.append(packed(version, tokens or [], files))
                size += len(bodies[-1])
                if size > BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
                    paths, bodies, size = [], [], 0

    return rows.select("path", "tokens", "files").mapInArrow(run, "path string, content binary")
