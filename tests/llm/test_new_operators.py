"""Conversation tries, periodic runs and the additive quality model against plain models, and on unusual tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramtrail.llm import conversation_trie as ct
from gramtrail.llm import quality_gam as gam
from gramtrail.llm import runs as rn
from gramtrail.llm.queries import QUERIES
from gramtrail.llm.textops import crc_mod, mix

from ..conftest import DATA

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def spaced(text):
    return [w for w in SPLIT.split(text or "") if w]


# Conversation trie


def plain_trie(rows, rebuild):
    """Every node by its sequence of turns, with sums by walking up from each."""
    talk = {}
    for c, turn, role, text in rows:
        if c is not None:
            talk.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talk = {c: [t[2:] for t in sorted(ts)] for c, ts in talk.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in talk}
        base = {c: c - (c % 20 if c >= 0 else -(-c % 20)) for c in talk}
        talk = {c: talk.get(base[c], [])[: h[c]] + ts[h[c] :] for c, ts in talk.items()}
    members, ends = {}, {}
    for c, ts in talk.items():
        ends.setdefault(tuple(ts), []).append(c)
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(own) - 1) * len(spaced(k[-1][1])) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(own), len(k), min(members[k[:-1]]) if k else -(10**9), len(own), kids.get(k, 0), leaves[k], saved[k], sha(ends.get(k, []))) for k, own in members.items())


def got_trie(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-(10**9) if v is None else v for v in r) for r in df.select(*names).collect())


TURNS = "conv_id long, turn long, role string, text string, score string, depth int, conv string"


def talks(seed, n, ids, most=6):
    r = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(r.randint(1, most)):
            rows.append((c, r.choice([t, t, t, None]) if seed % 2 else t, r.choice(["u", "a", None]), r.choice(["x", "y z", "y  z w", "", None]), "s", 1, "c"))
    return rows + rows[:n]


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie(spark, rebuild):
    for seed, ids in ((1, [*range(45), 60, 61, -3, -20, -25, 10**12, 10**12 + 1]), (2, [0, 20, 40, 7, 27])):
        rows = talks(seed, 5, ids) + [(None, 1, "u", "lost", None, None, None)]
        got = ct.trie(spark.createDataFrame(rows, TURNS), rebuild=rebuild)
        assert got_trie(got) == plain_trie([r[:4] for r in rows], rebuild)
    empty = spark.createDataFrame([], TURNS)
    assert ct.trie(empty, rebuild=rebuild).count() == 0 and ct.trie(spark.createDataFrame([(None, 1, "u", "x", None, None, None)], TURNS), rebuild=rebuild).count() == 0


def test_trie_in_blocks(spark, monkeypatch):
    """Long conversations and many members go through several blocks, branches hang on branches, and turnless conversations stay at the root."""
    monkeypatch.setattr(ct, "BLOCK", 4)
    monkeypatch.setattr(ct, "IDS", 3)
    rows = []
    for c in range(12):
        rows += [(c, t, "u", f"w{t}" if t < 25 - 2 * c else f"own{c} {t}", None, 0, "") for t in range(30 - c)]  # each leaves the first one earlier
    rows += [(c, t, "u", f"w{t}", None, 0, "") for c in range(100, 140) for t in range(9)]
    df = spark.createDataFrame(rows, TURNS)
    assert got_trie(ct.trie(df)) == plain_trie([r[:4] for r in rows], False)
    assert got_trie(ct.trie(df, rebuild=True)) == plain_trie([r[:4] for r in rows], True)
    for path in (1, 2):  # one conversation that holds nearly all rows, in several ranges
        numbered = ct.numbered(spark.createDataFrame([(path, t, "u", str(t), None, 0, "") for t in range(500)] + [(path, 3, "u", "again", None, 0, "")] * 50, TURNS))
        assert sorted(r.place for r in numbered.collect()) == list(range(1, 551))


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(QUERIES["op11_conversation_trie"](spark, str(DATA))) == plain_trie(rows, True)


# Periodic runs


def plain_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(r):
    n, k = r.choice([0, 1, 5, 8, 20, 60, 150]), r.choice([1, 2, 2, 3, 5, 50])
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n else 0):
        a, p = r.randrange(n), r.randint(1, 8)
        for i in range(a + p, min(n, a + r.randint(1, 60))):
            w[i] = w[i - p]
    return w + w[len(w) // 3 :] + [7] + w if r.random() < 0.3 else w


def test_runs():
    r = random.Random(5)
    for _ in range(800):
        docs = [random_words(r) for _ in range(r.randint(1, 5))]
        exponent, least = r.choice([2, 3, 4]), r.choice([2, 6])
        first = np.cumsum([0, *map(len, docs)])
        symbols = mix(np.array([(d << 32) + x for d, w in enumerate(docs) for x in w], np.uint64))
        assert rn.runs(symbols, first, least, exponent) == [plain_runs(w, least, exponent) for w in docs]


def test_previous_factors():
    r = random.Random(8)
    for _ in range(100):
        w = random_words(r)[:60]
        own = rn.Suffixes(np.array(w, np.uint64))
        assert [w[i:] for i in own.sa] == sorted(w[i:] for i in range(len(w)))
        length, source = own.previous() if w else (np.zeros(0), np.zeros(0))
        for i in range(len(w)):
            agree = lambda j: next((k for k in range(len(w) - i) if w[j + k] != w[i + k]), len(w) - i)  # noqa: B023, E731
            assert length[i] == max([agree(j) for j in range(i)], default=0) and (not length[i] or agree(int(source[i])) == length[i] and source[i] < i)


def plain_document(doc_id, text):
    w = spaced(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_run_rows(spark, edge, edge_rows, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: plain_document(r.doc_id, r.text) for r in docs.where("length(text) < 6000").collect()}
    for r in QUERIES["op12_periodic_runs"](spark, str(DATA)).collect():
        if r.doc_id in want:
            assert tuple(r)[1:] == want[r.doc_id]
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    key = lambda rows: sorted(rows, key=repr)
    short = [x for x in edge_rows if x[1] is None or len(x[1]) < 20_000 or " " not in x[1]]
    got = rn.find(spark.createDataFrame(short, edge.schema), keep=["doc_id"], seed=seed, digests=True).collect()
    assert key(map(tuple, got)) == key((x[0], *plain_document(x[0], x[1])) for x in short)
    whole = rn.find(edge.withColumn("__seed", F.lit("mine")).withColumn("start", F.lit("gone")))
    assert whole.columns[:9] == edge.columns and "__seed" in whole.columns and whole.schema["start"].dataType.simpleString() == "bigint" and whole.count() == len(edge_rows)
    assert rn.find(none).count() == 0
    text = "a b a b a b a b a b c " + "x " * 9 + "d"
    row = rn.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.runs == [[0, 10, 2], [11, 9, 1]] and row.collapsed == "a b c x d" and (row.start, row.length, row.period, row.exponent_milli) == (0, 10, 2, 5000)


# Quality


def plain_numbers(text):
    """The numbers of a text, one by one."""
    text = text or ""
    b = text.encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", b) if x]
    if not w:
        return [0.0] * len(gam.NAMES)
    low = [x.lower() for x in w]
    lines = [x for x in b.lower().split(b"\n") if x]
    share = lambda f, xs: sum(map(f, xs)) / max(1, len(xs))
    kinds = {
        "upper": lambda c: 65 <= c <= 90, "lower": lambda c: 97 <= c <= 122, "digits": lambda c: 48 <= c <= 57, "wide": lambda c: c >= 128, "ends": lambda c: c in b".,;:", "marks": lambda c: c in b"!?",
        "bars": lambda c: c in b"|/\\_~", "signs": lambda c: c in b"#$%&*+<=>@^", "quotes": lambda c: c in b"\"'()[]{}`-", "lines": lambda c: c == 10,
    }
    count = lambda x, k: sum(map(kinds[k], x))
    pairs = list(zip(low[:-1], low[1:], strict=True))
    return [
        np.log1p(len(w)), sum(map(len, w)) / len(w), np.log1p(max(map(len, w))), *[share(f, b) for f in kinds.values()],
        share(lambda x: count(x, "upper") > 1 and not count(x, "lower"), w), share(lambda x: not any(count(x, k) for k in ("upper", "lower", "wide")), w), sum(a == c for a, c in pairs) / len(w),
        len(set(low)) / len(w), max(map(low.count, set(low))) / len(w), len(set(pairs)) / max(1, len(w) - 1), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(w) / max(1, len(lines))),
    ]


def test_quality_numbers(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("aB9 \n\té.-!|#") for _ in range(r.randint(0, 80))) for _ in range(200)] + [None, "", " \n", "a", "A B", "x\nx\nx", "THE THE!!"]
    assert np.allclose(gam.features(pa.array(texts)), [plain_numbers(t) for t in texts])


def plain_score(model, x):
    z = model.base
    for k, (edge, table) in enumerate(zip(model.edges, model.tables, strict=True)):
        z += table[sum(e <= x[k] for e in edge)]
    for (i, j), table in model.pairs.items():
        z += table[sum(e <= x[i] for e in model.pair_edges[i]), sum(e <= x[j] for e in model.pair_edges[j])]
    return 1 / (1 + np.exp(-z))


def test_additive_model():
    """Tables find a bend in one feature and what only a pair of features tells; a score is a sum of entries."""
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(size=3000), r.random(3000), r.random(3000), np.repeat([1.0, 2.0, 2.0], 1000)])
    y = ((np.abs(x[:, 0]) > 1) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    held = model.scores(x[2000:])
    assert ((held > 0.5) == y[2000:]).mean() > 0.9 and any({i, j} & {1, 2} for i, j in model.pairs)
    alone = gam.fit(x[:2000], y[:2000], pairs=0)
    log_loss = lambda p: -np.mean(np.log(np.where(y[2000:] > 0, p, 1 - p)))
    assert log_loss(held) < log_loss(alone.scores(x[2000:])) and not alone.pairs
    assert np.allclose(held[:50], [plain_score(model, row) for row in x[2000:2050]])
    assert gam.fit(x[:10], np.ones(10)).scores(x[:2]).tolist() == [pytest.approx(10.5 / 11)] * 2 and gam.fit(np.zeros((0, 4)), np.zeros(0)).scores(x[:1]).tolist() == [0.5]


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality(spark, edge, edge_rows, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = gam.train(docs, labels, only=crc_mod("doc_id", 4) != 2)
    held = gam.score(docs.join(labels, "doc_id").where(crc_mod("doc_id", 4) == 2), model, keep=["quality"]).collect()
    assert len(held) > 80 and auc([(r.score, r.quality) for r in held]) > 0.98
    other = labels.withColumn("quality", F.when(crc_mod("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = gam.train(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz")), other, only=crc_mod("doc_id", 4) != 2)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))  # held-out labels, lang and source do not count
    got = gam.score(edge, model)
    assert got.columns == [*[c for c in edge.columns if c != "score"], "score"] and got.count() == len(edge_rows) and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert len({r.score for r in got.where("text is null or trim(text) = ''").collect()}) == 1 and gam.score(none, model).count() == 0
    assert gam.score(edge, gam.train(edge, labels.limit(0))).select("score").distinct().collect() == [(0.5,)]
    one = QUERIES["op13_quality"](spark, "/root/testdata/sf0.01").collect()
    assert len(one) == docs.count() and all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in one)


# Plain models of two older operators


def test_shards_in_plain(spark):
    """Ranks, shares and cuts of every row, computed one by one from the same shuffling hashes."""
    from gramtrail.llm import interleave

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "src1").otherwise(F.col("source")))
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(content) + 1).alias("size"), F.crc32(content).alias("crc"), F.xxhash64(F.lit(interleave.SEED), "doc_id", F.crc32(content)).alias("h")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.crc)):
        by.setdefault("n" if r.source is None else "s" + r.source, []).append(r)
    every = sorted(((i + 0.5) / len(own), kind, i, r) for kind, own in by.items() for i, r in enumerate(own))
    least, more, want = len(every) // 16, len(every) % 16, []
    for shard in range(16):
        n = least + (shard < more)
        want += [(r.doc_id, r.source, r["size"], r.crc, shard, slot) for slot, (_, _, _, r) in enumerate(every[:n])]
        every = every[n:]
    assert sorted(map(tuple, interleave.interleave(docs).collect()), key=repr) == sorted(want, key=repr)


def plain_mix(x):
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def test_toxicity_in_plain():
    """Features word by word, and each weight of FTRL by its own sums."""
    import math

    from gramtrail.llm import toxicity_ftrl as tox
    from gramtrail.llm.textops import ALNUM, Words, utf8_parts

    r, bits, m = random.Random(2), 12, (1 << 64) - 1
    texts = [" ".join(r.choice("Aa b1 c d e fool g h".split()) for _ in range(r.randint(0, 12))) for _ in range(150)]
    hashed = lambda w: int(Words(*utf8_parts(pa.array([w])), ALNUM).h[0])
    rows = []
    for t in texts:
        h = [hashed(w) for w in re.findall(r"[a-z0-9]+", t.lower())]
        own = {plain_mix(x ^ 11) for x in h} | {plain_mix((a * 0x9E6C63D0876A9A35 + b) & m) for a, b in zip(h, h[1:])} | {plain_mix((a * 0xC2B2AE3D27D4EB4F + b) & m) for a, b in zip(h, h[2:])}  # noqa: B905
        own = {x & ((1 << bits) - 1) for x in own}
        f, d = tox.features(Words(*utf8_parts(pa.array([t])), ALNUM), bits)
        assert set(f.tolist()) == own
        rows.append((sorted(own), int("fool" in t)))
    alpha, beta, l1, l2, z, n = 1.0, 1.0, 0.5, 0.1, {}, {}

    def weight(i):
        s = 0.0 if i == "bias" else l1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= s else -(v - math.copysign(s, v)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(3):
        for own, y in rows:
            keys = [*own, "bias"]
            w = {i: weight(i) for i in keys}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in keys:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
    model = tox.ftrl([(np.array(own, np.int64), y) for own, y in rows], bits=bits, l1=l1)
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert set(model.index.tolist()) == set(want) and np.allclose(model.weight, [want[i] for i in model.index.tolist()], atol=1e-4)
    words = Words(*utf8_parts(pa.array(texts)), ALNUM)
    assert np.allclose(model.scores(words, model.dense()), [1 / (1 + math.exp(-(model.bias + sum(want.get(i, 0.0) for i in own)))) for own, _ in rows], atol=1e-4)
