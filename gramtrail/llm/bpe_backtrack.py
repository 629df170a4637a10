"""Exact SentencePiece BPE by backtracking, and decoding.

The text, with a leading space and spaces as U+2581, falls into segments that no piece
crosses. In a segment an Aho-Corasick automaton finds the pieces that start at each place.
Encoding takes the longest one that may follow the token before it; a pair of tokens may stand side by side if
merging their joint text anew gives just these two. Where none may, the last token is taken back;
a bit field keeps places already found to fail. Characters without a piece become byte
pieces. Frequent segments are kept in a table of bounded size per task.

Cases: a null or empty text has the end id alone and decodes to nothing; empty tables give no
rows; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textops import map_docs

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Entries of a task's tables of segments and of token pairs.
KEPT_SEGMENTS, KEPT_PAIRS = 500_000, 1_000_000
FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


INF = float("inf")


class Codec:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [own.id_to_piece(i) for i in range(own.vocab_size())]
        self.end, self.unknown = own.eos_id(), own.unk_id()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if own.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(len(self.pieces)) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -own.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character: segments are not independent")
        for probe, wants in (("a  b é ﬁ", "▁a▁▁b▁é▁ﬁ"),):
            if own.encode(probe) != [i for i in self._library_free(wants)]:
                raise ValueError("the model changes its texts; only models that take them as they are can be used")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.total, self.sizes = len(self.pieces), [len(p) for p in self.pieces]
        #: The longest piece that is a proper prefix of a piece.
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.known = Known(self)
        self.special = {self.end, self.unknown, *self.byte_of}

    def _library_free(self, segments: str) -> list[int]:
        return [i for s in SEGMENT.findall(segments) for i in self.merged(s)]

    def merged(self, s: str) -> list[int]:
        """Ids of a segment by merging: again and again the best-scored piece of two neighbours, leftmost first."""
        if len(s) > 40:
            return self._merged_long(s)
        rank = self.rank.get
        part = list(s)
        order = [rank(part[a] + part[a + 1], INF) for a in range(len(s) - 1)]
        while order:
            best = min(order)
            if best is INF:
                break
            a = order.index(best)
            part[a : a + 2] = [part[a] + part[a + 1]]
            del order[a]
            if a < len(order):
                order[a] = rank(part[a] + part[a + 1], INF)
            if a:
                order[a - 1] = rank(part[a - 1] + part[a], INF)
        return [i for p in part for i in self._ids_of(p)]

    def _merged_long(self, s: str) -> list[int]:
        """The same with a heap."""
        part: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap: list = []

        def offer(a: int) -> None:
            b = right[a]
            if a >= 0 and b < len(part) and (r := self.rank.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[b], b))

        for a in range(len(s) - 1):
            offer(a)
        while heap:
            _, a, joint, b = heapq.heappop(heap)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != joint:
                continue
            part[a], part[b], right[a] = joint, None, right[b]
            if right[b] < len(part):
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [i for p in part if p is not None for i in self._ids_of(p)]

    def _ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def may_follow(self, a: int, b: int) -> bool:
        key = a * self.total + b
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            out = self.pairs[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return out

    def segment(self, s: str) -> list[int]:
        """Ids of a segment by backtracking."""
        pairs, total, n = self.pairs, self.total, len(s)
        # The leftmost longest matches in a row are the answer if each may follow the one before.
        out, size, last, ok = [], 0, -1, True
        for _, i in self.automaton.iter_long(s):
            if last >= 0:
                ok = pairs.get(last * total + i)
                if ok is None:
                    ok = self.may_follow(last, i)
                if not ok:
                    break
            out.append(i)
            size += self.sizes[i]
            last = i
        if ok and size == n and (len(out) > 1 or self.may_follow_alone(out[0])):
            return out
        return self._backtrack(s)

    def _longest(self, s: str, at: int) -> int:
        """The longest piece at a place, -1 without one."""
        for end, i in self.automaton.iter_long(s, at):
            return i if end - self.sizes[i] + 1 == at else -1
        return -1

    def _backtrack(self, s: str) -> list[int]:
        pairs, total, sizes, shorter, n = self.pairs, self.total, self.sizes, self.shorter, len(s)
        failed, out, at, last, i = bytearray(n // 8 + 1), [], 0, -1, self._longest(s, 0)  # a bit a place
        while at < n:
            if i < 0 and s[at] not in self.ids:  # byte pieces, which merge with nothing
                out.append(-1 - at)
                last, at = -1, at + 1
                i = self._longest(s, at) if at < n else -1
                continue
            while i >= 0:
                size = sizes[i]
                if not failed[at + size >> 3] >> (at + size & 7) & 1:
                    if last < 0:
                        ok = size == 1 or self.may_follow_alone(i)
                    else:
                        ok = pairs.get(last * total + i)
                        if ok is None:
                            ok = self.may_follow(last, i)
                    if ok:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, last = at + size, i
                if at < n:
                    i = self._longest(s, at)
            else:  # nothing can follow here: take the last token back and try a shorter one
                if not out or out[-1] < 0:  # not reached: the tokens of the plain merging always may follow each other
                    return self.merged(s)
                failed[at >> 3] |= 1 << (at & 7)
                i = out.pop()
                at -= sizes[i]
                i = shorter[i]
                last = out[-1] if out else -1
        return [j for i in out for j in ([i] if i >= 0 else self._ids_of(s[-1 - i]))]

    def may_follow_alone(self, i: int) -> bool:
        """Whether merging the text of a piece anew gives the piece."""
        key = -1 - i
        out = self.pairs.get(key)
        if out is None:
            out = self.pairs[key] = self.merged(self.pieces[i]) == [i]
        return out

    def segments_of(self, text: str) -> list[str]:
        """Segments without the U+2581 that each begins with."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return [s[1:] for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, text: str | None) -> list[int]:
        """Ids with the end id."""
        return [i for s in self.segments_of(text or "") for i in self.segment(SPACE + s)] + [self.end]

    def _raw(self, ids: list[int]) -> str:
        if not self.special.intersection(ids):
            return "".join(map(self.pieces.__getitem__, ids))
        out, run = [], bytearray()
        for i in [*ids, -1]:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i in (-1, self.end):
                continue
            out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: spaces for U+2581 without the leading one, bytes joined to characters, control ids left out."""
        raw = self._raw(ids)
        return (raw[1:] if raw.startswith(SPACE) else raw).replace(SPACE, " ")

    def digest(self, text: str | None) -> tuple[str, str, str]:
        """The ids joined by spaces, and digests of these and of the decoded text."""
        segments = self.segments_of(text or "")
        ids = ("".join(map(self.known.__getitem__, segments)) + f" {self.end}")[1:]
        raw = SPACE.join(map(self.known.spelt, segments) if self.known.odd else segments)  # without the leading one
        decoded = raw.replace(SPACE, " ")
        return ids, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class Known(dict):
    """Ids of segments as text, each id after a space. Two generations of bounded size; a segment still in use moves to the younger one."""

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}
        #: Segments whose ids decode to something else than the segment.
        self.odd: dict[str, str] = {}

    def __missing__(self, s: str) -> str:
        out = self.old.get(s)
        if out is None:
            ids = self.codec.segment(SPACE + s)
            out = " " + " ".join(map(str, ids))
            raw = self.codec._raw(ids)[1:]
            if raw != s:
                self.odd[s] = raw
        if len(s) <= 64:
            if len(self) >= KEPT_SEGMENTS:
                self.old = dict(self)
                self.clear()
            self[s] = out
        return out

    def spelt(self, s: str) -> str:
        return self.odd.get(s, s)


_CODEC: list = [None, None]


def codec(model: bytes) -> Codec:
    """The codec of a model, kept by the Python worker between tasks."""
    key = hashlib.sha256(model).digest()
    if _CODEC[0] != key:
        _CODEC[:] = key, Codec(model)
    return _CODEC[1]


def round_trip(docs: DataFrame, model_path: str, *, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Kept columns with n_tokens, ids_sha256 and decoded_sha256 of each whole text, and the ids themselves if asked for."""
    with open(model_path, "rb") as f:  # the tokenizer's own file, half a megabyte, read by the driver alone
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        own = codec(shared.value)

        def each(texts, _):
            got = [own.digest(x) for x in texts.to_pylist()]
            out = [np.array([x[0].count(" ") + 1 for x in got], np.int64), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())]
            if ids:
                flat = np.fromstring(" ".join(x[0] for x in got), np.int32, sep=" ")
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(out[0])]).astype(np.int32)), pa.array(flat)))
            return out

        return each

    fields = T.StructType([*FIELDS, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if ids else FIELDS
    return map_docs(docs, text, list(docs.columns if keep is None else keep), fields, make)


def encode_ids(docs: DataFrame, model_path: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with the ids themselves and the decoded text."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        own = codec(shared.value)

        def each(texts, _):
            ids = [own.encode(x) for x in texts.to_pylist()]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())]

        return each

    return map_docs(docs, text, list(docs.columns if keep is None else keep), T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]), make)
