"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The network reads windows of 64 characters that overlap by half. A tag holds from the window in which its character is
most central, or from the outermost one that was run; the tags of a text then form one sequence, from which spans are read
across windows. A span must hold a digit or an at sign and LEAST characters, so windows without either are run only where a
span goes on into them.

Training takes at most `max_windows` windows, those with the least hash, of at most `max_docs` documents with such a
character, those with the smallest hash of the id (documented bounds); the base patterns label them, and windows with what may be personal data
that these miss take no part. Lines made from a seed have personal data in other forms and numbers that are none. Cases: a null or empty text has no
spans; without training documents the made lines train alone; repeated rows each get a row.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import Span, apart, digest, joined
from .textops import map_docs

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
MAX_DOCS, MAX_WINDOWS, MADE = 1500, 8, 2200
#: The least length of a span that the network may add; a@b.c has five.
LEAST = 5
#: Places of a document that may be personal data which the base patterns miss: these are no examples of places without any.
DOUBTFUL = re.compile(r"[0-9](?:[ .()/-]?[0-9]){8,}|\S\s?@\s?\S")
WIDTH, STRIDE = 64, 32
TAGS = 9  # outside, then begin and inside of each kind
FIELDS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

#: Classes of characters: letters without case, digits, marks one by one, the rest by kind.
_MARKS = " \n\t.,:;@+-_%()/[]<>\"'#*&="
_CLASS = np.full(128, 36, np.uint8)
for _c in range(128):
    if chr(_c).isalpha():
        _CLASS[_c] = ord(chr(_c).lower()) - 97
    elif chr(_c).isdigit():
        _CLASS[_c] = 26 + _c - 48
    elif chr(_c) in _MARKS:
        _CLASS[_c] = 38 + _MARKS.index(chr(_c))
OTHER, PAD = 37, 38 + len(_MARKS)
N_CLASSES = PAD + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, found from each at sign."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            out.append(m.span())
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping for each kind, without those that fail."""
    out: list[Span] = [(0, *s) for s in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c in string.digits for c in m[0]) <= 15]
    return out


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], OTHER).astype(np.uint8)


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    starts: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.update(j * STRIDE for j in (k - 1, k) if j >= 0)
    return sorted(starts) or []


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    """Weights: x, h of both directions (input by class, recurrent), output, bias, and CRF moves."""

    x: np.ndarray  # 2, classes, 4 * hidden
    h: np.ndarray  # 2, hidden, 4 * hidden
    out: np.ndarray  # 2 * hidden, tags
    bias: np.ndarray
    move: np.ndarray

    @classmethod
    def new(cls, hidden: int = 16, seed: int = 3) -> "Net":
        r = np.random.default_rng(seed)
        x = r.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)).astype(np.float32)
        x[:, :, hidden : 2 * hidden] += 1
        return cls(x, r.normal(0, 0.2, (2, hidden, 4 * hidden)).astype(np.float32), r.normal(0, 0.2, (2 * hidden, TAGS)).astype(np.float32), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))

    def run(self, codes: np.ndarray, keep: bool = False):
        """Emissions of windows (n, width), and what the gradient needs."""
        n, width = codes.shape
        hidden = self.h.shape[1]
        states, saved = np.zeros((n, width, 2 * hidden), np.float32), []
        for way in (0, 1):
            h, c, steps = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32), []
            for t in range(width) if way == 0 else range(width - 1, -1, -1):
                g = self.x[way][codes[:, t]] + h @ self.h[way]
                g[:, : 3 * hidden] = _sigmoid(g[:, : 3 * hidden])
                g[:, 3 * hidden :] = np.tanh(g[:, 3 * hidden :])
                i, f, o, u = (g[:, k * hidden : (k + 1) * hidden] for k in range(4))
                old, before = c, h
                c = f * c + i * u
                tc = np.tanh(c)
                h = o * tc
                states[:, t, way * hidden : (way + 1) * hidden] = h
                if keep:
                    steps.append((t, g, old, before, tc))
            saved.append(steps)
        return states @ self.out + self.bias, states, saved

    def step(self, codes: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean CRF loss of windows; padding counts as outside."""
        n, width = codes.shape
        hidden = self.h.shape[1]
        e, states, saved = self.run(codes, True)
        fore, aft = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0]
        for t in range(1, width):
            fore[:, t] = _lse(fore[:, t - 1][:, :, None] + self.move, 1) + e[:, t]
            s = width - 1 - t
            aft[:, s] = _lse(self.move + (e[:, s + 1] + aft[:, s + 1])[:, None, :], 2)
        total = _lse(fore[:, -1], 1)
        de = np.exp(fore + aft - total[:, None, None])
        d_move = np.zeros_like(self.move)
        for t in range(1, width):
            d_move += np.exp(fore[:, t - 1][:, :, None] + self.move + (e[:, t] + aft[:, t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(d_move, (tags[:, t - 1], tags[:, t]), -1)
        de[np.arange(n)[:, None], np.arange(width), tags] -= 1
        d_out = np.einsum("nth,ntk->hk", states, de)
        ds = de @ self.out.T
        dx, dh_w = np.zeros_like(self.x), np.zeros_like(self.h)
        for way in (0, 1):
            dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
            for t, g, old, before, tc in reversed(saved[way]):
                i, f, o, u = (g[:, k * hidden : (k + 1) * hidden] for k in range(4))
                dh = dh + ds[:, t, way * hidden : (way + 1) * hidden]
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * u * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
                np.add.at(dx[way], codes[:, t], dg)
                dh_w[way] += before.T @ dg
                dh, dc = dg @ self.h[way].T, dc * f
        return [p / n for p in (dx, dh_w, d_out, de.sum((0, 1)), d_move)]

    def fit(self, codes: np.ndarray, tags: np.ndarray, *, epochs: int | None = None, batch: int = 64, rate: float = 0.02, seed: int = 4) -> "Net":
        """Adam over shuffled batches; by default as many passes as make some 800 steps, six at least."""
        epochs = epochs or max(6, -(-800 * batch // max(1, len(codes))))
        r, parts = np.random.default_rng(seed), [self.x, self.h, self.out, self.bias, self.move]
        m, v, k = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for epoch in range(epochs):
            order = r.permutation(len(codes))
            for a in range(0, len(order), batch):
                k += 1
                for p, g, mi, vi in zip(parts, self.step(codes[order[a : a + batch]], tags[order[a : a + batch]]), m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= rate * 0.02 ** (epoch / epochs) * (mi / (1 - 0.9**k) / (np.sqrt(vi / (1 - 0.999**k)) + 1e-8)).astype(p.dtype)
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi tags of windows."""
        e, _, _ = self.run(codes)
        n, width = codes.shape
        best, back = e[:, 0], np.zeros((n, width, TAGS), np.uint8)
        for t in range(1, width):
            both = best[:, :, None] + self.move
            back[:, t] = both.argmax(1)
            best = both.max(1) + e[:, t]
        tags = np.zeros((n, width), np.uint8)
        tags[:, -1] = best.argmax(1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def window_rows(text: str, base: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of the windows of a text that are run."""
    code = classes(text)
    tags = np.zeros(len(code), np.uint8)
    for k, a, b in sorted(base, key=lambda s: -s[0]):
        tags[a:b], tags[a] = 2 + 2 * k, 1 + 2 * k
    starts = windows(text)
    c, g = np.full((len(starts), WIDTH), PAD, np.uint8), np.zeros((len(starts), WIDTH), np.uint8)
    for i, s in enumerate(starts):
        part = code[s : s + WIDTH]
        c[i, : len(part)], g[i, : len(part)] = part, tags[s : s + WIDTH]
    return c, g


def made(n: int, seed: int = 8) -> list[tuple[str, list[Span]]]:
    """Lines with personal data in other forms, and with numbers that are none."""
    rng = random.Random(seed)
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    low, dig = string.ascii_lowercase, string.digits
    personal = (
        (0, lambda: f"{some(low, 3, 8)}.{some(dig, 2, 2)} @ {some(low, 4, 8)}.{rng.choice(('com', 'org', 'net', 'de'))}"), (0, lambda: f"{some(low, 3, 9)}@{some(low, 4, 8)}.{rng.choice(('com', 'org', 'fr'))}"),
        (1, lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4))), (2, lambda: " ".join(some(dig, 4, 4) for _ in range(4))), (2, lambda: some(dig, 16, 16)),
        (3, lambda: f"({some(dig, 3, 3)}) {some(dig, 3, 3)}-{some(dig, 4, 4)}"), (3, lambda: f"{some(dig, 3, 3)}-{some(dig, 3, 3)}-{some(dig, 4, 4)}"), (3, lambda: f"+{some(dig, 1, 2)} {some(dig, 3, 3)} {some(dig, 3, 3)} {some(dig, 4, 4)}"),
        (3, lambda: f"{some(dig, 3, 3)}.{some(dig, 3, 3)}.{some(dig, 4, 4)}"), (2, lambda: f"{some(dig, 4, 4)} {some(dig, 6, 6)} {some(dig, 5, 5)}"), (2, lambda: "-".join(some(dig, 4, 4) for _ in range(4))),
        (2, lambda: some(dig, 16, 16)), (3, lambda: f"{some(dig, 3, 3)}-{some(dig, 3, 3)}-{some(dig, 4, 4)}"),
    )
    others = (lambda: some(dig, 1, 6), lambda: f"20{some(dig, 2, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 9)},{some(dig, 3, 3)},{some(dig, 3, 3)}", lambda: some(low, 2, 5) + some(dig, 2, 6), lambda: some("0123456789abcdef", 18, 40), lambda: f"token = \"{some('0123456789abcdef', 20, 40)}\"", lambda: "AKIA" + some(string.ascii_uppercase + dig, 16, 16), lambda: f"password={some('0123456789abcdef', 16, 20)}")
    two = lambda top: f"{rng.randint(0, top):02d}"
    plain = (
        lambda: f"97{rng.choice('89')}-{some(dig, 1, 1)}-{some(dig, 2, 4)}-{some(dig, 4, 6)}-{some(dig, 1, 1)}", lambda: f"97{rng.choice('89')}-{rng.randint(0, 99)}-{some(dig, 2, 3)}-{some(dig, 5, 6)}-{some(dig, 1, 1)}", lambda: f"97{rng.choice('89')}{some(dig, 10, 10)}", lambda: some(dig, 12, 12), lambda: f"{rng.randint(0, 9)}-{some(dig, 3, 3)}-{some(dig, 5, 5)}-{some(dig, 1, 1)}",
        lambda: f"20{two(30)}-{two(12)}-{two(28)}{rng.choice(' T')}{two(23)}:{two(59)}:{two(59)}", lambda: f"{two(28)}.{two(12)}.20{two(30)} {two(23)}:{two(59)}", lambda: f"{rng.choice(('', 'v'))}{rng.randint(0, 20)}.{rng.randint(0, 40)}.{rng.randint(0, 2000)}", lambda: f"{rng.choice(('version ', 'release ', 'v'))}{rng.randint(0, 30)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}",
        lambda: some(dig, 7, 13), lambda: some(dig, 11, 13), lambda: f"id {some(dig, 9, 14)}", lambda: f"{some(low, 2, 3).upper()}-{some(dig, 6, 10)}", lambda: f"{some(dig, 3, 6)}/{some(dig, 2, 4)}/{some(dig, 2, 4)}", lambda: some(dig, 20, 34), lambda: f"{some(dig, 1, 3)} {some(dig, 3, 3)} {some(dig, 3, 3)}",
    )
    out = []
    for _ in range(n):
        head, tail = (" ".join(some(low, 2, 9) for _ in range(rng.randint(0, 5))) for _ in range(2))
        kind, make = rng.choice(personal) if rng.random() < 0.55 else (-1, rng.choice(others))
        if kind < 0 and rng.random() < 0.6:
            make = rng.choice(plain)
        value = make()
        a = len(head) + 1
        out.append((f"{head} {value} {tail}", [(kind, a, a + len(value))] if kind >= 0 else []))
    return out


def sampled(text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of at most so many windows of a text, those with the least hash, without those that hold a doubtful place."""
    base = base_spans(text)
    codes, tags = window_rows(text, base)
    doubt = [m.span() for m in DOUBTFUL.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in base)]
    good = [i for i, s in enumerate(windows(text)) if not any(a < s + WIDTH and s < b for a, b in doubt)]
    good = sorted(good, key=lambda i: zlib.crc32(codes[i].tobytes()))[:most]
    return codes[good], tags[good]


def train(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS, made_lines: int = MADE) -> Net:
    """A network from a bounded sample of the documents, labelled by the base patterns, and made lines."""
    few = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").alias("doc_id")).where(F.col("text").rlike("[0-9@]"))
    order = F.xxhash64("doc_id", F.lit(9)), "doc_id"
    ids = few.select("doc_id").where("doc_id is not null").distinct().orderBy(*order).limit(max_docs)

    def make():
        def each(texts, _):
            rows = [sampled(x or "", max_windows) for x in texts.to_pylist()]
            return [pa.array([c.tobytes() for c, _ in rows], pa.binary()), pa.array([g.tobytes() for _, g in rows], pa.binary())]

        return each

    found = map_docs(few.join(F.broadcast(ids), "doc_id"), "text", ["doc_id"], T.StructType([T.StructField("c", T.BinaryType()), T.StructField("g", T.BinaryType())]), make)  # at most max_docs ids
    rows = found.dropDuplicates(["doc_id"]).orderBy(*order).limit(max_docs).collect()
    pairs = [(np.frombuffer(r.c, np.uint8).reshape(-1, WIDTH), np.frombuffer(r.g, np.uint8).reshape(-1, WIDTH)) for r in rows] + [window_rows(t, s) for t, s in made(made_lines)]
    return Net.new().fit(np.concatenate([c for c, _ in pairs]), np.concatenate([g for _, g in pairs]))


def reconciled(tags: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The tags of a text of n characters from those of its windows: the window in which a place is most central counts; the outermost ones up to their edges."""
    out, quarter = np.zeros(n, np.uint8), (WIDTH - STRIDE) // 2
    for s, g in tags.items():
        a = s if s - STRIDE not in tags else s + quarter
        b = min(n, s + WIDTH if s + STRIDE not in tags else s + WIDTH - quarter)
        if a < b:
            out[a:b] = g[a - s : b - s]
    return out


def model_spans(texts: list[str], net: Net, most: int = 4096, least: int = LEAST) -> list[list[Span]]:
    """Spans that the network finds in whole texts; windows of many texts run together, and then those into which a span goes on."""
    starts = [windows(t) for t in texts]
    codes = [classes(t) if s else None for t, s in zip(texts, starts, strict=True)]
    tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
    todo, quarter = [(d, s) for d, each in enumerate(starts) for s in each], (WIDTH - STRIDE) // 2
    while todo:
        more: set[tuple[int, int]] = set()
        for i in range(0, len(todo), most):
            part = todo[i : i + most]
            c = np.full((len(part), WIDTH), PAD, np.uint8)
            for k, (d, s) in enumerate(part):
                x = codes[d][s : s + WIDTH]
                c[k, : len(x)] = x
            got = net.decode(c)
            ahead, behind = (got[:, :quarter] > 0).any(1), (got[:, -quarter:] > 0).any(1)
            for k, (d, s) in enumerate(part):
                tags[d][s] = got[k]
                if ahead[k] and s:
                    more.add((d, s - STRIDE))
                if behind[k] and s + WIDTH < len(codes[d]):
                    more.add((d, s + STRIDE))
        todo = sorted((d, s) for d, s in more if s not in tags[d])
    out: list[list[Span]] = []
    for d, text in enumerate(texts):
        spans: list[Span] = []
        if tags[d]:
            tag = reconciled(tags[d], len(codes[d]))
            kind = (tag.astype(int) + 1) // 2
            edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | ((tag[1:] % 2 == 1) & (tag[:-1] % 2 == 0)), [True]])) if len(tag) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if kind[a] and b - a >= least and TRIGGER.search(text, int(a), int(b)):
                    spans.append((int(kind[a]) - 1, int(a), int(b)))
        out.append(spans)
    return out


def find(texts: list[str], net: Net) -> list[tuple[list[Span], list[Span]]]:
    """Base spans of each text, and what the network adds."""
    return [(base, apart(more, base)) for t, more in zip(texts, model_spans(texts, net), strict=True) for base in [base_spans(t)]]


def scan(docs: DataFrame, net: Net, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with n_email, n_ip, n_card, n_phone, base_sha256 and spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some ten thousand weights

    def make():
        net = shared.value

        def each(texts, _):
            got = find([x or "" for x in texts.to_pylist()], net)
            counts = [np.array([sum(s[0] == k for s in base) for base, _ in got], np.int64) for k in range(4)]
            return [*counts, pa.array([digest(base, KINDS) for base, _ in got], pa.string()), pa.array([joined(base + more, KINDS) for base, more in got], pa.string())]

        return each

    return map_docs(docs, text, list(docs.columns if keep is None else keep), FIELDS, make)
