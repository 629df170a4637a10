"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits and + / _ -. Tags are outside, begin and inside of a secret.
Viterbi runs over all tokens of a text, but for those that a bound leaves outside: a span is part of a best path only if
its emissions and moves gain over outside, and no run of tokens through such a token has an upper bound of that
gain above zero. Bounds come from the token itself (kept by string), the words before it and the marks
beside it; what they keep falls into runs, which give the result of the whole text. Features: shape, length,
alphabet, entropy, the neighbouring words, and of the file whether it names secrets and how many numbers it has.

Training takes at most `max_docs` documents, those with the smallest hash of the id, and of each the PIECES pieces of PIECE
tokens with the smallest hash and as many with base spans (documented bounds); the base patterns label them, and tokens that may
be secrets which these miss take no part. Lines made from
a seed have secrets of other forms, some of letters alone or short, and numbers, dates, names and paths
that are none. Cases: a null or empty text has no spans; without
training documents the made lines train alone; repeated rows each get a row.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import Span, apart, digest, joined
from .textops import map_docs

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")
CHARS = r"A-Za-z0-9+/_-"
SPLIT = re.compile(f"([{CHARS}]+)")
NEIGHBOUR = re.compile(f"[{CHARS}]+|[^\\s{CHARS}]")
MAX_DOCS, MADE = 2000, 2000
#: Tokens of a piece that trains, and pieces of a document.
PIECE, PIECES = 16, 1
#: Strings whose bounds a task keeps.
KEPT = 300_000
OUT, BEGIN, INSIDE = range(3)
FIELDS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping for each kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(n in low for n in NAMES):
            out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


#: Lower-case letters as a, capitals as A, digits as 9.
_SHAPE = str.maketrans(string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "9" * 10)
_REPEATED, _HEXADECIMAL = re.compile(r"(.)\1+"), re.compile("[0-9a-f]+")


def _own(s: str) -> list[str]:
    """Features of the token itself."""
    n, full = len(s), s.translate(_SHAPE)
    digits, shape = full.count("9"), _REPEATED.sub(r"\1", full)
    if digits == n:
        alphabet = "digits"
    elif _HEXADECIMAL.fullmatch(s):
        alphabet = "hex"
    else:
        alphabet = ("l" if "a" in full else "") + ("u" if "A" in full else "") + ("d" if digits else "") + ("s" if any(c in shape for c in "+/_-") else "")
    spoken = f"{round(8 * sum(map(s.count, 'aeiouAEIOU')) / max(1, n - digits))}" if "A" in full else ""  # lower-case tokens differ by length and entropy alone
    return [f"spoken={spoken}", "bias", f"shape={shape[:6]}", f"length={min(40, n) // 4}", f"alphabet={alphabet}", f"entropy={_entropy(s, n):.0f}", f"digits={round(4 * digits / n)}", f"runs={round(8 * len(shape) / n)}", f"marks={min(4, n - sum(map(full.count, 'aA9')))}"]


def _entropy(s: str, n: int) -> float:
    some = set(s)
    if len(some) == n:
        return _log2(1, n)
    return sum([k * _log2(k, n) for k in map(s.count, some)]) / n


@lru_cache(4096)
def _log2(k: int, n: int) -> float:
    return math.log2(n / k)


def _features(text: str, a: int, b: int, file: list[str]) -> list[str]:
    start = max(0, a - 48)
    before = NEIGHBOUR.findall(text[start:a])
    if start and before and TOKEN.match(text[start]) and TOKEN.match(text[start - 1]):
        before = before[1:]  # cut off
    before = [x.lower() for x in before[-3:]]
    after = NEIGHBOUR.findall(text[b : b + 24].lower())[:1]
    words = [x for x in before if x[0].isascii() and x[0].isalnum()]
    out = [*_own(text[a:b]), f"mark={before[-1] if before and not before[-1][0].isalnum() else ''}", f"next={after[0] if after and not after[0][0].isalnum() else ''}", *file]
    return out + [f"word{len(words) - 1 - i}={w[:12]}" for i, w in enumerate(words)]


def _file(text: str) -> list[str]:
    low = text.lower()
    return [f"file:names={any(n in low for n in NAMES)}", f"file:many={min(3, len(DIGITS.findall(text)).bit_length())}", f"file:key={'-----BEGIN' in text}"]


def chain_of(text: str, spots: list[tuple[int, int]], file: list[str]) -> list[tuple[int, int, list[str]]]:
    return [(a, b, _features(text, a, b, file)) for a, b in spots]


def chains(text: str) -> list[list[tuple[int, int, list[str]]]]:
    """All tokens (start, end, features) of a text, as one chain."""
    spots = [m.span() for m in TOKEN.finditer(text)]
    return [chain_of(text, spots, _file(text))] if spots else []


class Rows(dict):
    """Rows of numbers by string, each made once."""

    def __init__(self, width: int, make):
        self.make, self.table = make, np.zeros((1024, width))

    def __missing__(self, key: str) -> int:
        i = self[key] = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.make(key)
        return i

    def of(self, keys: list[str]) -> np.ndarray:
        at = list(map(self.__getitem__, keys))
        return self.table[at]


class Bounds:
    """Which tokens of a text may be part of a secret under a model."""

    def __init__(self, model: "Crf"):
        self.model, m = model, model.move
        w = model.weight
        self.lift = {f: (float(w[i, BEGIN] - w[i, OUT]), float(w[i, INSIDE] - w[i, OUT])) for f, i in model.index.items()}
        self.words: dict[str, tuple] = {}
        self.plain: dict[tuple[int, bool], float] = {}
        for f in model.index:
            if f.startswith("word"):
                old, i = self.words.get(f[6:], (0.0, 0.0, 0.0)), int(f[4])
                self.words[f[6:]] = (*old[:i], max(0.0, *self.lift[f]), *old[i + 1 :])
        self.known, self.gaps = Rows(5, self._token), Rows(2, self._between)
        self.most = tuple(max([0.0, *[self.gain([f]) for f in model.index if f.startswith(k)]]) for k in ("mark=", "next="))
        # A span BEGIN INSIDE ... instead of outside: one way in and out, and a move for each further token.
        self.ends = max(m[a, BEGIN] + m[x, b] - m[a, OUT] - m[OUT, b] for a in range(3) for x in (BEGIN, INSIDE) for b in (OUT, BEGIN))
        self.stay = max(m[BEGIN, INSIDE], m[INSIDE, INSIDE]) - m[OUT, OUT]

    def gain(self, features: list[str]) -> float:
        """Most that the features give to a tag over outside."""
        begin = inside = 0.0
        for f in features:
            if f in self.lift:
                x, y = self.lift[f]
                begin, inside = begin + x, inside + y
        return max(begin, inside)

    def _token(self, token: str) -> tuple[float, ...]:
        """The gain of a token, the most that it adds as word 0, 1 and 2 before another, and whether it counts as a mark."""
        n = len(token)
        if token.isalpha() and token.islower() and not _HEXADECIMAL.fullmatch(token):  # most tokens: they differ by length and entropy alone
            kind = n, round(_entropy(token, n))
            own = self.plain.get(kind)
            if own is None:
                own = self.plain[kind] = self.gain(_own(token))
        else:
            own = self.gain(_own(token))
        return own, *self.words.get(token.lower()[:12], (0.0, 0.0, 0.0)), float(not token[0].isalnum())

    def _between(self, gap: str) -> tuple[float, float]:
        """What the text between two tokens gives as mark to the one after it, and as next to the one before it."""
        if len(gap) > 16:  # a feature may not see all of it
            return self.most
        before, after = [x.lower() for x in NEIGHBOUR.findall(gap)[-1:]], NEIGHBOUR.findall(gap.lower())[:1]
        return tuple(self.gain([f"{k}={x[0] if x and not x[0][0].isalnum() else ''}"]) for k, x in (("mark", before), ("next", after)))

    def runs(self, text: str) -> list[list[tuple[int, int, list[str]]]]:
        """Runs of neighbouring tokens that some span of positive gain may hold."""
        parts = SPLIT.split(text)
        tokens = parts[1::2]
        if not tokens or not self.model.index:
            return []
        for x in (self.known, self.gaps):
            if len(x) > KEPT:
                x.clear()
        file, own, gaps = _file(text), self.known.of(tokens), self.gaps.of(parts[::2])
        n, mark = len(tokens), own[:, 4] > 0
        x = own[:, 0] + (self.gain(file) + self.stay)
        x[0] += gaps[0, 0]
        x += gaps[1:, 1]
        x[1:] += gaps[1:-1, 0]
        if mark.any():  # a token of marks alone may itself be the mark beside another, and words have other numbers after it
            x[1:] += np.where(mark[:-1], self.most[0] - gaps[1:-1, 0], 0)
            x[:-1] += np.where(mark[1:], self.most[1] - gaps[1:-1, 1], 0)
            odd, any_word = np.zeros(n, bool), own[:, 1:4].max(1)
            for i in range(min(3, n - 1)):
                odd[i + 1 :] |= mark[: n - i - 1]
            for i in range(min(3, n - 1)):
                x[i + 1 :] += np.where(odd[i + 1 :], any_word[: n - i - 1], own[: n - i - 1, 1 + i])
        else:
            for i in range(min(3, n - 1)):
                x[i + 1 :] += own[: n - i - 1, 1 + i]
        sums = np.concatenate([[0.0], np.cumsum(x)])
        best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])  # of the runs through each token
        keep = np.flatnonzero(best + self.ends - self.stay > -1e-6)
        if not len(keep):
            return []
        spots = [m.span() for m in TOKEN.finditer(text)]
        return [chain_of(text, [spots[i] for i in run], file) for run in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1)]


@dataclass
class Crf:
    """Weights of features by tag, and of transitions."""

    index: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    FORBIDDEN = -1e9

    def emissions(self, chain: list[list[str]]) -> tuple[np.ndarray, list[list[int]]]:
        at = [[self.index[f] for f in fs if f in self.index] for fs in chain]
        return np.array([self.weight[i].sum(0) if i else np.zeros(3) for i in at]), at

    def _moves(self) -> np.ndarray:
        m = self.move.copy()
        m[OUT, INSIDE] = self.FORBIDDEN
        return m

    def viterbi(self, chain: list[list[str]]) -> list[int]:
        """Best tags; the tokens around a chain are outside."""
        if not self.index:
            return [OUT] * len(chain)
        e, _ = self.emissions(chain)
        m = self._moves()
        best, back = m[OUT] + e[0], []
        for row in e[1:]:
            both = best[:, None] + m
            back.append(both.argmax(0))
            best = both.max(0) + row
        tags = [int((best + m[:, OUT]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def fit(self, rows: list[tuple[list[list[str]], list[int]]], *, epochs: int = 6, rate: float = 0.4, l2: float = 1e-4, least: int = 3) -> "Crf":
        """Gradient ascent with AdaGrad on the likelihood of each chain in turn."""
        seen = Counter(f for chain, _ in rows for fs in chain for f in set(fs))
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
        self.weight, self.move = np.zeros((len(self.index), 3)), np.zeros((3, 3))
        gw, gm = np.full(self.weight.shape, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(epochs if self.index else 0):
            for chain, tags in rows:
                e, at = self.emissions(chain)
                m, n = self._moves(), len(chain)
                fore, aft = np.zeros((n, 3)), np.zeros((n, 3))
                fore[0], aft[-1] = m[OUT] + e[0], m[:, OUT]
                for i in range(1, n):
                    fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + m, 0) + e[i]
                    aft[-1 - i] = np.logaddexp.reduce(m + e[n - i] + aft[n - i], 1)
                total = np.logaddexp.reduce(fore[-1] + aft[-1])
                p = np.exp(fore + aft - total)
                d = -np.zeros((3, 3))
                d[OUT] -= p[0]
                d[:, OUT] -= p[-1]
                d[OUT, tags[0]] += 1
                d[tags[-1], OUT] += 1
                for i in range(1, n):
                    d -= np.exp(fore[i - 1][:, None] + m + e[i] + aft[i] - total)
                    d[tags[i - 1], tags[i]] += 1
                gm += d * d
                self.move += rate * d / np.sqrt(gm)
                for i, idx in enumerate(at):
                    g = -p[i]
                    g[tags[i]] += 1
                    gw[idx] += g * g
                    self.weight[idx] += rate * g / np.sqrt(gw[idx]) - l2 * self.weight[idx]
        return self


LEADS = ("the pwd is {}", "private key: {}", "auth: bearer {}", "export ACCESS_KEY {}", "credential {} for login", "client_secret {}", "api key {} ok", "x-api-key: {}", "sign in with passphrase {} now", "webhook signing {}")
PLAIN = ("order {} was sent", "see page {} of it", "on {} we met", "version {} is out", "call {} at noon", "item no. {} sold", "file {} was read", "room {} is free", "train {} leaves", "the year {} and", "isbn {}", "from {} on", "id {} in the list")

#: Leads of names, ids and times as they stand in code, logs and links.
CODE = ("call {}() first", "def {}(self):", "the class {} is", "at {} it ran", "see {} for more", "open {} now", "const {} = 3;", "row {} was", "uuid {}", "log {} info", "return {};", "key: {}", "value={}", "{}")


def _name(rng: random.Random) -> str:
    """A name, id, time or link that is no secret."""
    low, dig = string.ascii_lowercase, string.digits
    some = lambda chars, least, most: "".join(rng.choice(chars) for _ in range(rng.randint(least, most)))
    parts = ["".join(rng.choice("bcdfghklmnprstvwz") * rng.randint(0, 1) + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 6))]
    two = lambda top: f"{rng.randint(0, top):02d}"
    kind = rng.randrange(10)
    if kind < 3:
        return (parts[0] if kind else parts[0].capitalize()) + "".join(p.capitalize() for p in parts[1:])
    if kind == 3:
        return "_".join(parts)
    if kind == 4:
        return "_".join(parts).upper()
    if kind == 5:
        return "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))
    if kind == 6:
        return f"20{two(30)}-{two(12)}-{two(28)}T{two(23)}:{two(59)}:{two(59)}{rng.choice(('Z', '', '.' + some(dig, 3, 6) + 'Z', '+0' + some(dig, 1, 1) + ':00'))}"
    if kind == 9:  # a long compound
        return "".join(rng.choice(("sch", "st", "ff", "ts", "pf", "gl", "d", "n", "br", "k")) + rng.choice("aeiou") + rng.choice(("ch", "ft", "rt", "n", "ll", "mpf", "s", "hrts")) for _ in range(rng.randint(3, 7))).capitalize()
    path = "/".join([f"{some(low, 3, 9)}.{rng.choice(('com', 'org', 'net', 'io'))}", *parts[: rng.randint(0, 2)]])
    return f"https://{path}?{rng.choice(('v', 'id', 'p', 'ref', 'q'))}={some(string.ascii_letters + dig, 8, 14)}" if kind == 7 else f"https://www.{path}/{some(string.ascii_letters + dig + '_-', 8, 12)}"


def made(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the places of their secrets: about half hold one."""
    rng = random.Random(seed)
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    secrets = (lambda: some(low + up + dig, 16, 44), lambda: some("0123456789abcdef", 12, 64), lambda: "ghp_" + some(low + up + dig, 30, 38), lambda: "sk-" + some(low + dig, 20, 48), lambda: some(low + up + dig + "+/", 24, 60), lambda: some(up + dig, 14, 32), lambda: some(low + dig, 10, 14) + "-" + some(low + dig, 8, 14), lambda: some(low + up, 14, 40), lambda: some(low + up, 14, 40), lambda: some(up, 16, 32), lambda: some(low + up + "+/", 20, 50))
    others = (lambda: some(dig, 8, 13), lambda: f"20{some(dig, 2, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 12)}/{rng.randint(10, 28)}/20{some(dig, 2, 2)}", lambda: f"chapter-{some(low, 4, 8)}-{rng.randint(1, 99)}", lambda: f"img_{some(dig, 6, 8)}", lambda: f"src/{some(low, 3, 8)}/{some(low, 3, 8)}{rng.randint(1, 9)}", lambda: some(low, 7, 14) + str(rng.randint(1, 99)), lambda: f"{some(dig, 3, 4)}-{some(dig, 4, 4)}-{some(dig, 3, 4)}", lambda: some(up, 2, 4) + "-" + some(dig, 6, 9), lambda: some(low, 3, 12), lambda: some(up, 1, 1) + some(low, 3, 11), lambda: some(up, 2, 8), lambda: some(low, 3, 8) + "-" + some(low, 3, 8), lambda: some(up, 1, 1) + some(low, 3, 7) + some(up, 1, 1) + some(low, 3, 7))
    out = []
    for _ in range(n):
        secret = rng.random() < 0.5
        lead = rng.choice(LEADS) if secret and rng.random() < 0.8 else rng.choice(PLAIN)
        value = rng.choice(secrets if secret else others)()
        if not secret and rng.random() < 0.5:
            lead, value = rng.choice(CODE + PLAIN), _name(rng)
        if secret and lead in LEADS and rng.random() < 0.1:
            value = some(low + up + dig, 6, 7)
        head = " ".join(some(low, 2, 8) for _ in range(rng.randint(0, 3)))
        a = len(head) + 1 + lead.index("{")
        out.append((f"{head} {lead.format(value)}", [(a, a + len(value))] if secret else []))
    return out


def labelled(text: str, own: list[tuple[int, int]] | None = None) -> list[tuple[list[list[str]], list[int]]]:
    """Chains of a text with the tags that the base patterns, or the given spans, give: of a given line the whole, of others pieces without doubtful tokens."""
    base = [(a, b) for _, a, b in base_spans(text)] if own is None else own
    spots, file = [m.span() for m in TOKEN.finditer(text)], _file(text)
    tags, last, ahead = [], None, sorted(base)
    for a, b in spots:
        while ahead and ahead[0][1] <= a:
            ahead.pop(0)
        hit = ahead[0] if ahead and ahead[0][0] < b else None
        tags.append(OUT if hit is None else INSIDE if hit == last and tags[-1] != OUT else BEGIN)
        last = hit
    cuts = [(0, len(spots))] if own is not None else [(i, min(i + PIECE, len(spots))) for i in range(0, len(spots), PIECE)]
    if own is None:
        order = sorted(cuts, key=lambda c: zlib.crc32(text[spots[c[0]][0] : spots[c[1] - 1][1]].encode("utf-8", "replace")))
        cuts = sorted({*order[:PIECES], *[c for c in order if any(tags[c[0] : c[1]])][:PIECES]})
        unknown = [t == OUT and _doubtful(text[a:b]) for (a, b), t in zip(spots, tags, strict=True)]
        cuts = [(i, j) for c in cuts for i, j in _between_marked(unknown, *c)]
    return [([f for _, _, f in chain_of(text, spots[i:j], file)], tags[i:j]) for i, j in cuts if j > i]


def _doubtful(token: str) -> bool:
    """Whether a token of a document may be a secret that the base patterns miss, so that it is no example of an outside one; made lines have names, ids and times that are none."""
    digits, capitals = sum(c.isdigit() for c in token), sum(c.isupper() for c in token[1:])
    return len(token) >= 8 and (0 < digits < len(token) or len(token) >= 12 and capitals > 0)


def _between_marked(marked: list[bool], a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a range without its marked places."""
    edges = [a - 1, *[i for i in range(a, b) if marked[i]], b]
    return [(i + 1, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def train(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_docs: int = MAX_DOCS, made_lines: int = MADE) -> Crf:
    """A model from a bounded sample of the documents, labelled by the base patterns."""
    few = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    order = F.xxhash64("doc_id", F.lit(2)), "doc_id"
    ids = few.select("doc_id").where("doc_id is not null").distinct().orderBy(*order).limit(max_docs)

    def make():
        return lambda texts, _: [pa.array([json.dumps(labelled(x or "")) for x in texts.to_pylist()], pa.string())]

    found = map_docs(few.join(F.broadcast(ids), "doc_id"), "text", ["doc_id"], T.StructType([T.StructField("rows", T.StringType())]), make)  # at most max_docs ids
    rows = found.dropDuplicates(["doc_id"]).orderBy(*order).limit(max_docs).collect()
    return Crf().fit([(c, t) for r in rows for c, t in json.loads(r["rows"])] + [x for line, own in made(made_lines) for x in labelled(line, own)])


def find(text: str, model: Crf, bounds: Bounds | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and what the model adds to them."""
    base, more = base_spans(text), []
    for chain in (bounds or Bounds(model)).runs(text):
        start = None
        for (a, b, _), tag in [*zip(chain, model.viterbi([f for _, _, f in chain]), strict=True), ((0, 0, 0), OUT)]:
            if tag != INSIDE and start is not None:
                more.append((3, *start))
                start = None
            if tag != OUT:
                start = (a, b) if start is None else (start[0], b)
    return base, apart(more, base)


def scan(docs: DataFrame, model: Crf, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with n_assign, n_access, n_hex, base_sha256 and spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of max_docs documents at most

    def make():
        model, bounds = shared.value, Bounds(shared.value)

        def each(texts, _):
            got = [find(x or "", model, bounds) for x in texts.to_pylist()]
            counts = [np.array([sum(s[0] == k for s in base) for base, _ in got], np.int64) for k in range(3)]
            return [*counts, pa.array([digest(base, KINDS) for base, _ in got], pa.string()), pa.array([joined(base + more, KINDS) for base, more in got], pa.string())]

        return each

    return map_docs(docs, text, list(docs.columns if keep is None else keep), FIELDS, make)


def mask(text: str | None, spans: str, fill: str = "[SECRET]") -> str | None:
    """The text with each span replaced; overlapping spans become one."""
    if not spans or text is None:
        return text
    out, at = [], 0
    runs: list[list[int]] = []
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], fill]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Crf, *, text: str = "text", fill: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of the text replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, bounds = shared.value, Bounds(shared.value)

        def one(x):
            if x is None:
                return None
            base, more = find(x, model, bounds)
            return mask(x, joined(base + more, KINDS), fill)

        return lambda texts, _: [pa.array([one(x) for x in texts.to_pylist()], pa.string())]

    return map_docs(docs, text, docs.columns, T.StructType([T.StructField(text, T.StringType())]), make).select(*[F.col(f"`{c}`") for c in docs.columns])
