"""Stored corpora: changes without a rewrite, readers that go on reading, writers that meet, and the forms of earlier programs."""

import base64
import gzip
import json
import struct
import time

import pytest
from pyspark.sql import functions as F

from gramtrail import Corpus
from gramtrail.operators import fuzzy, phrase
from gramtrail.sources import files as source
from gramtrail.sources import store, stored

from .conftest import positions
from .test_search import files


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def key(c):
    return sorted(tuple(r) for r in c.paired.select("pos", "token", "doc_id", "local_pos", "line_no", "next").collect())


def test_update_writes_changes_alone(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    rows = {i: f"word{i} of the\nfile {i}" for i in range(50)} | {3: "", 49: ""}
    Corpus.from_files(frame(spark, list(rows.items()))).save(at)
    new = {7: "quite new of the text", 8: rows[8], 60: "added of the end", 2: ""}
    after = store.update(spark, at, frame(spark, list(new.items())))
    rows |= new
    want = Corpus.from_files(frame(spark, list(rows.items())))
    assert key(after) == key(want) == key(Corpus.load(spark, at))
    m = store.manifest(spark, at)
    assert len(m["tokens"]) == 2 and spark.read.parquet(f"{at}/{m['tokens'][1]}").count() == 9 and spark.read.parquet(f"{at}/{m['contents'][1]}").count() == 3
    assert positions(after.phrase(["of", "the"])) == positions(want.phrase(["of", "the"])) and after.phrase(["word7", "of"]).count() == 0
    assert sorted(map(tuple, after.files.collect())) == sorted(map(tuple, want.files.collect()))
    assert store.update(spark, at, frame(spark, [(8, rows[8])])) and store.manifest(spark, at)["number"] == m["number"]  # nothing changed
    assert key(store.compact(spark, at, 2)) == key(want) and len(store.manifest(spark, at)["tokens"]) == 1


def test_append_reads_nothing_else(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    for name, text in (("a", "one two"), ("b", ""), ("c", "two\none"), ("d", "six")):
        c = store.append(spark, at, spark.createDataFrame([(name, text)], "path string, text string"))
    assert key(c) == key(files(spark, [("a", "one two"), ("b", ""), ("c", "two\none"), ("d", "six")]))
    assert [r.path for r in c.files.orderBy("doc_id").collect()] == list("abcd") and positions(c.phrase(["two", "two"])) == [1]
    more = store.import_tokens(spark, at, source.token_list(spark, ["six", "one"]))
    assert positions(more.phrase(["six", "six"])) == [4] and positions(more.phrase(["six", "one"])) == [5]
    last = store.append(spark, at, spark.createDataFrame([("e", "seven")], "path string, text string"))
    assert positions(last.phrase(["six", "seven", "six", "one"])) == [4]
    assert key(store.compact(spark, at)) == key(last)


def test_readers_and_writers(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/index"
    files(spark, [("a", "one two")]).save(at)
    old = Corpus.load(spark, at)
    new = old.update(frame(spark, [(0, "three one two")]))
    assert new.save(at)
    assert positions(old.phrase(["one", "two"])) == [0] and positions(new.phrase(["one", "two"])) == [1] == positions(Corpus.load(spark, at).phrase(["one", "two"]))

    real, calls = store._switch, []

    def slow(s, path, body, number):
        if not calls:  # another writer is faster, once
            calls.append(number)
            real(s, path, store.manifest(s, path) | {"fingerprint": "other"}, number)
        real(s, path, body, number)

    monkeypatch.setattr(store, "_switch", slow)
    assert positions(store.update(spark, at, frame(spark, [(5, "one two")])).phrase(["one", "two"])) == [1, 3] and calls
    calls.clear()
    with pytest.raises(store.Conflict):
        files(spark, [("z", "lost")]).save(at)
    monkeypatch.setattr(store, "_switch", real)
    assert positions(Corpus.load(spark, at).phrase(["one", "two"])) == [1, 3]
    assert store.vacuum(spark, at) == 0 and positions(old.phrase(["one", "two"])) == [0]
    assert store.vacuum(spark, at, -60) > 3 and positions(Corpus.load(spark, at).phrase(["one", "two"])) == [1, 3]


def test_repeated_ids(spark):
    with pytest.raises(Exception, match="given twice"):
        Corpus.from_files(frame(spark, [(1, "a b"), (1, "c d"), (2, "e")])).tokens.collect()
    assert Corpus.from_files(frame(spark, [(None, "a b"), (2, "e")])).tokens.count() == 1


def test_layouts(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    c = Corpus.from_files(frame(spark, [(i, f"alpha beta{i} gamma thee the them then other wörter") for i in range(40)]))
    store.save(c, at, layouts=True)
    again = Corpus.load(spark, at)
    assert again.pairs is not None and "sequence" in str(again.sequence.inputFiles())
    for word, d in (("thee", 1), ("themm", 2), ("gama", 1), ("beta11", 1), ("worter", 1), ("wörtr", 1)):
        want = {(r.token, r.dist) for r in fuzzy.candidates(c, word, d).collect()}
        assert {(r.token, r.dist) for r in fuzzy.candidates(again, word, d).collect()} == want
    asked = fuzzy.asked_pairs(again, "beta1122", 1)
    assert len(asked) <= 3 and again.pairs.where(F.col("pair").isin(asked)).count() < again.lexicon.count()
    assert sorted(map(tuple, again.phrase(["alpha"]).collect())) == sorted(map(tuple, c.phrase(["alpha"]).collect()))
    assert store.update(spark, at, frame(spark, [(0, "x")])).pairs is None  # layouts are of one state
    assert store.compact(spark, at, layouts=True).pairs is not None


def test_windows_read_their_pages(spark, tmp_path):
    """Rows of the layout by position that a search reads grow with its hits, not with the corpus."""
    at = f"file://{tmp_path}/index"
    store.save(Corpus.from_files(frame(spark, [(i, " ".join(f"w{i}" if k == 7 else "common" for k in range(2000))) for i in range(100)])), at, layouts=True)
    c, adaptive = Corpus.load(spark, at), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = phrase.positions(c, ["w50"])
        near = c.near(spark.createDataFrame(hits.collect(), hits.schema), 3, 1, few=True)
        rows = near.collect()
        plan = near._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        read = [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if "parquet" in leaves.apply(i).toString().lower()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(r.pos for r in rows) == [100_004, 100_005, 100_006, 100_007]
    assert len(read) == 1 and 4 <= read[0] <= 4 * store.PAGE < 200_000 and c.tokens.count() == 200_000


def test_dirty(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    c = files(spark, [("a", "one two")])
    assert store.is_dirty(c, at)
    c.save(at)
    assert not store.is_dirty(c, at) and store.is_dirty(files(spark, [("a", "one three")]), at)


# Forms of earlier programs


def packed(version, tokens, maps, **more):
    body = {"version": version, "total_tokens": len(tokens), "compressed_tokens": list(gzip.compress("\n".join(tokens).encode())) if version < 4 else more.pop("raw"), "token_positions": maps} | more
    return b"VIBE" + struct.pack("<I", version) + json.dumps(body).encode()


def plain_bitmap(values):
    """One container of sorted numbers under 65,536."""
    return base64.b64encode(struct.pack("<IIHHI", 12346, 1, 0, len(values) - 1, 16) + struct.pack(f"<{len(values)}H", *values)).decode()


def test_bitmaps():
    run = struct.pack("<I", 12347 | 1 << 16) + b"\x02" + struct.pack("<HHHH", 0, 1, 2, 20) + struct.pack("<HH", 5, 9) + struct.pack("<HHHHH", 2, 3, 4, 100, 0)
    assert stored.bitmap_positions(run).tolist() == [5, 9, *[(2 << 16) + x for x in (3, 4, 5, 6, 7, 100)]]
    import numpy as np

    for values in ([], [0], [7, 65_535, 65_536, 10**9], range(0, 20_000, 2), [*range(5000), *range(70_000, 70_010)]):
        assert stored.bitmap_positions(stored.bitmap_of(np.array(values, np.int64))).tolist() == list(values)


def test_stored_forms(spark, tmp_path):
    texts = [("x.rs", "one two\none"), ("y.rs", "two of the")]
    want = files(spark, texts)
    tokens = "one two one two of the".split()
    at = {t: [i for i, x in enumerate(tokens) if x == t] for t in dict.fromkeys(tokens)}
    names, number = list(at), {t: i for i, t in enumerate(at)}
    members = [{"path": p, "content": c, "token_start": 3 * i, "token_end": 3 * i + 3, "line_offsets": [], "token_line_map": [], "token_count": 3, "content_hash": 1} for i, (p, c) in enumerate(texts)]
    raw = list(gzip.compress(struct.pack("<Q6I", 6, *[number[t] for t in tokens])))
    forms = {
        1: packed(1, tokens, {t: json.dumps(p) for t, p in at.items()}), 2: packed(2, tokens, {t: json.dumps(p) for t, p in at.items()}), 3: packed(3, tokens, {t: plain_bitmap(p) for t, p in at.items()}),
        4: packed(4, tokens, {str(number[t]): plain_bitmap(p) for t, p in at.items()}, raw=raw, lexicon=names, file_index={"files": members}),
    }
    for v, content in forms.items():
        (tmp_path / f"v{v}").mkdir()
        (tmp_path / f"v{v}/a.idx").write_bytes(content)
        got = stored.load_stored(spark, f"file://{tmp_path}/v{v}")
        assert sorted((r.pos, r.token) for r in got.tokens.collect()) == list(enumerate(tokens)) and positions(got.phrase(["one", "two"])) == [0, 2]
        own = stored.binary_files(spark, f"file://{tmp_path}/v{v}")
        assert sorted((r.pos, r.token) for r in stored.posting_rows(own).collect()) == list(enumerate(tokens)) and stored.problems(own).count() == 0
    assert sorted((r.pos, r.token, r.doc_id, r.line_no) for r in got.tokens.collect()) == sorted((r.pos, r.token, r.doc_id, r.line_no) for r in want.tokens.collect())
    assert [(r.path, r.token_start, r.token_end) for r in got.files.orderBy("doc_id").collect()] == [("x.rs", 0, 3), ("y.rs", 3, 6)]
    (tmp_path / "all").mkdir()
    bad = {"c": b"nope", "d": b"VIBE" + struct.pack("<I", 9) + b"{}", "e": b"VIBE" + struct.pack("<I", 1) + b'{"compressed_tokens": [1, 2]}', "f": b"VIBE" + struct.pack("<I", 4) + b"{}"}
    for name, content in {"a": forms[4], "g": forms[3], **bad}.items():
        (tmp_path / f"all/{name}").write_bytes(content)
    both = stored.load_stored(spark, f"file://{tmp_path}/all")
    assert sorted((r.pos, r.token) for r in both.tokens.collect()) == list(enumerate(tokens * 2)) and positions(both.phrase(["the", "one"])) == [5]
    assert sorted(r.path[-1] for r in stored.problems(stored.binary_files(spark, f"file://{tmp_path}/all")).collect()) == list("cde")


def test_stored_forms_grow_with_the_text(spark):
    """A document of four times as many distinct words is packed in about four times the time, and named tokens alone are read."""

    def took(n):
        words, best = [f"w{i}" for i in range(n)], 1e9
        for _ in range(3):
            began = time.perf_counter()
            stored.packed(1, words)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(80_000) < 8 * took(20_000)
    tokens = ["b", "a", "b", "c"]
    for v in stored.VERSIONS:
        own = spark.createDataFrame([("x", bytearray(stored.packed(v, tokens)))], "path string, content binary")
        for rows in (stored.token_rows, stored.posting_rows):
            assert sorted((r.token, r.pos) for r in rows(own, ["b", "z"]).collect()) == [("b", 0), ("b", 2)]
            assert rows(own).count() == 4
