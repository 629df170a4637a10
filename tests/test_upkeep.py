"""Updates, storage, streams, prompts and the SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from gramtrail import Corpus
from gramtrail.functions.registry import register
from gramtrail.operators import bitmaps, context, evaluate, incremental, lines, phrase
from gramtrail.sources import files as source
from gramtrail.sources import store
from gramtrail.streaming import hot_cold

from .conftest import positions
from .test_search import files, stream


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_update_equals_rebuild(spark):
    base = frame(spark, [(0, "fn oldfunc x"), (1, "second file here"), (2, "third x")])
    new = frame(spark, [(0, "fn newfunc with more tokens x"), (1, "second file here"), (7, "added x")])
    old = Corpus.from_files(base)
    assert {(r.doc_id, r.status) for r in incremental.changes(old, new).collect()} == {(0, "changed"), (1, "same"), (7, "added")}
    got = old.update(new)
    want = Corpus.from_files(frame(spark, [(0, "fn newfunc with more tokens x"), (1, "second file here"), (2, "third x"), (7, "added x")]))
    key = lambda c: sorted(map(tuple, c.tokens.select("token", "pos", "doc_id", "local_pos", "line_no").collect()))
    assert key(got) == key(want)
    assert positions(got.phrase(["second", "file"])) == [6] and got.phrase(["fn", "oldfunc"]).count() == 0


def test_store(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    c = files(spark, [("a", "one two\nthree"), ("b", "one two")])
    assert store.save(c, at) is True and store.save(c, at) is False
    again = Corpus.load(spark, at)
    assert positions(again.phrase(["one", "two"])) == [0, 3] and again.files.count() == 2
    more = store.import_tokens(spark, at, source.token_list(spark, ["one", "two", "six"]))
    assert positions(more.phrase(["one", "two"])) == [0, 3, 5]
    store.compact(spark, at, 1)
    assert store.storage_stats(spark, at)["total_tokens"] == 8
    assert store.delete(spark, at) and not store.delete(spark, at)
    assert Corpus.load(spark, at).tokens.count() == 0


def test_store_sees_every_change(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    assert store.save(files(spark, [("a", "a b")]), at)
    moved = files(spark, [("a", "a\n{b}")])  # the same tokens at the same positions
    assert moved.save(at) is True and moved.save(at) is False
    again = Corpus.load(spark, at)
    assert again.files.first().content == "a\n{b}" and [r.line_no for r in again.tokens.orderBy("pos").collect()] == [1, 2]
    assert files(spark, [("b", "a\n{b}")]).save(at) is True  # another path


def test_store_survives_a_failed_save(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/index"
    store.save(files(spark, [("a", "one two")]), at)
    monkeypatch.setattr(store, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save(files(spark, [("a", "three four five")]), at)
    assert positions(Corpus.load(spark, at).phrase(["one", "two"])) == [0]


def test_next_tokens(spark):
    c = files(spark, [("a", "one two"), ("b", ""), ("c", "two one"), ("d", "")])
    rows = [(r.pos, r.token, r.next) for r in c.paired.orderBy("pos").collect()]
    assert rows == [(0, "one", "two"), (1, "two", "two"), (2, "two", "one"), (3, "one", None)]
    bare = Corpus.from_tokens(spark.createDataFrame([(f"t{i}", i) for i in (0, 1, 3, 65_535, 65_536)], "token string, pos long"))
    assert {(r.pos, r.next) for r in bare.paired.collect()} == {(0, "t1"), (1, None), (3, None), (65_535, "t65536"), (65_536, None)}


def test_folders_and_totals(spark):
    c = files(spark, [("a/x", "one two"), ("a/b/y", "three"), ("z", "four five six")])
    assert {tuple(r) for r in evaluate.by_folder(c).collect()} == {("a", 2, 3), ("", 1, 3)}
    rows = spark.createDataFrame([(0, 100, 20), (1, 100, 30)], "chunk_id long, whole_tokens long, injected_tokens long")
    assert tuple(evaluate.totals(rows).first()) == (200, 50, 0.75) and tuple(evaluate.totals(rows.limit(0)).first()) == (0, 0, 0.0)


def test_unreadable_store(spark, tmp_path):
    (tmp_path / "x/manifest").mkdir(parents=True)
    (tmp_path / "x/manifest/part-0.txt").write_text("no")
    with pytest.warns(UserWarning):
        assert Corpus.load(spark, f"file://{tmp_path}/x").tokens.count() == 0
    (tmp_path / "x/manifest/part-0.txt").write_text(json.dumps({"version": 99}))
    with pytest.warns(UserWarning):
        assert Corpus.load(spark, f"file://{tmp_path}/x").tokens.count() == 0


def test_old_version(spark, tmp_path):
    source.token_list(spark, ["a", "b"]).write.parquet(f"file://{tmp_path}/x/tokens")
    (tmp_path / "x/manifest").mkdir()
    (tmp_path / "x/manifest/part-0.txt").write_text(json.dumps({"version": 2}))
    assert positions(Corpus.load(spark, f"file://{tmp_path}/x").phrase(["a", "b"])) == [0]


def test_folder_and_text(spark, tmp_path):
    for p, t in (("b/x.rs", "fn b"), ("a.rs", "fn a"), ("target/z.rs", "no"), (".git/y.rs", "no"), ("c.txt", "no")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    assert [(r.doc_id, r.path) for r in source.folder(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "a.rs"), (1, "b/x.rs")]
    (tmp_path / "t.txt").write_text(" a\tb\n c ")
    assert [r.token for r in source.text_tokens(spark, str(tmp_path / "t.txt")).orderBy("pos").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("size", [1, 3, 4, 5, 100])
def test_hot_cold(spark, tmp_path, size):
    s = hot_cold.TokenStream(spark, f"file://{tmp_path}/s", size)
    assert tuple(s.stats().first()) == (0, 0, 0, 0)
    words = "fn main ( ) { let mut cache".split()
    for n, part in enumerate((words[:3], words[3:7], words[7:])):
        s.append(spark.createDataFrame(list(enumerate(part)), "ord long, token string"), n)
    s.append(spark.createDataFrame(list(enumerate(words[7:])), "ord long, token string"), 2)  # a batch that runs again
    cold = sum(len(json.dumps(words[i : i + size], separators=(",", ":"))) for i in range(0, 8 // size * size, size))
    assert tuple(s.stats().first()) == (8 % size, 8 // size, 8, cold)
    assert [(r.token, r.pos, r.next) for r in s.rows().orderBy("pos").collect()] == list(zip(words, range(8), [*words[1:], None], strict=True))
    for asked, wants in ((["fn", "main"], [0]), (["let", "mut"], [5]), ([")", "{"], [3]), (["not_here", "found"], [])):
        assert positions(hot_cold.TokenStream(spark, f"file://{tmp_path}/s", size).phrase(asked)) == wants
    assert [r.token for r in s.token_at(6).collect()] == ["mut"]
    if size == 4:
        assert [r.left_context for r in s.phrase([")", "{"]).collect()] == ["fn main ( )"]


def test_stream(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n * 10 + i, w) for i, w in enumerate("the end of".split())], "ord long, token string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    s = hot_cold.TokenStream(spark, f"file://{tmp_path}/s", 4)
    s.start(spark.readStream.schema("ord long, token string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), ["ord"], f"file://{tmp_path}/c")
    assert positions(s.phrase(["of", "the"])) == [2, 5] and s.stats().first().total_tokens == 9


def test_adjacent_repeats(spark):
    c = stream(spark, "a a b b b c")
    assert positions(phrase.adjacent_repeats(c)) == [0, 2, 3]
    assert positions(phrase.adjacent_repeats(c, 3)) == [0, 3]


def test_prompts(spark):
    c = stream(spark, " ".join(f"t{i}" for i in range(20)))
    kept = context.relevant_positions(c, phrase.positions(c, ["t5"]), context.PromptConfig(window=2))
    assert positions(kept, "pos") == [3, 4, 5, 6, 7]
    big = stream(spark, " ".join(["a"] * 250))
    for n, config, wants in ((150, context.PromptConfig(window=0), 150), (250, context.PromptConfig(window=0), 125), (150, context.PromptConfig(window=0, strict_budget=True), 75)):
        assert context.relevant_positions(big, big.tokens.where(f"pos < {n}").selectExpr("pos AS position"), config).count() == wants
    row = context.build_prompt(c, "what?", [["t5", "t6"]], context.PromptConfig(window=0, min_confidence=0.9)).first()
    assert row.prompt_tokens == ["<context>", "[5]", "t5", "</context>", "<query>", "what?", "</query>"] and row.filtered_token_count == 7
    row = context.build_prompt(c, "what?", [["none"]]).first()
    assert "(no relevant context found)" in row.prompt_tokens
    assert context.completion_prompt(c, "q", [["t5", "t6"]]).first().prompt == "Answer the query from the passages between the context marks.\n\n<context>\n  [POS 5] " + " ".join(f"t{i}" for i in range(15)) + "\n</context>\n\n\nQuery: q\nAnswer:"
    assert "[MATCH: a b] {{ .Context.a b }}" in context.template_text([["a", "b"]]) and "{{.Context}}" in context.task_template("docs")


def test_messages(spark):
    c = files(spark, [("a", "fn main runs here"), ("b", "other"), ("c", "more")])
    out = context.chat_messages(c, "what about main", [["fn", "main"]], 31)
    system, user = (r.content for r in out.orderBy("ord").collect())
    assert "[POS 0] fn main runs here" in system and user.endswith("what about main")
    assert json.loads(context.request_json(out).first().request)["messages"][1]["role"] == "user"
    got = context.ask(c, "main", [["fn", "main"]], lambda request: "fn main( { broken code")
    assert not got["syntax_valid"] and got["confidence_adjustment"] == -0.4 and len(got["issues"]) == 3


def test_feedback_of_ask(spark, tmp_path):
    c, log = files(spark, [("a", "fn main runs here")]), f"file://{tmp_path}/log"
    replies = iter(["fn main() {}", "fn main( {", "let x = 1;"])
    got = [context.ask(c, "main", [["fn", "main"]], lambda request: next(replies), log=log)["confidence"] for _ in range(3)]
    assert got == [1.0, 0.5, pytest.approx(2 / 3)] and context.noted(spark, log, "other", False) == 0.0


def test_lines_by_bytes(spark):
    texts = {0: "é\n\nlonger line\n", 1: "", 2: "x" * 9000 + "\n" + "y" * 5000 + "\nz"}
    table = lines.line_table(spark.createDataFrame(list(texts.items()), "doc_id long, content string"))
    places = [(d, b) for d, t in texts.items() for b in {0, 1, 2, 3, 4, 10, 8999, 9000, 9001, 14_001, 14_002, 14_003, 10**6, -5}]
    got = lines.at_bytes(table, spark.createDataFrame(places, "doc_id long, byte long")).collect()
    want = {(d, b): texts[d].encode()[: max(0, min(b, len(texts[d].encode())))].count(b"\n") + 1 for d, b in places}
    assert {(r.doc_id, r.byte): r.line_no for r in got} == want and len(got) == len(places)


def test_bitmaps(spark):
    c = stream(spark, "a b a b a c " * 9000)
    assert positions(bitmaps.phrase(c, ["a", "b", "a"])) == positions(phrase.positions(c, ["a", "b", "a"])) and bitmaps.phrase(c, ["a", "zz"]).count() == 0
    rows = bitmaps.positions_of(bitmaps.postings(c).drop("n"))
    assert sorted(map(tuple, rows.collect())) == sorted((r.token, r.pos) for r in c.tokens.collect())
    assert dict(map(tuple, bitmaps.sizes(c).collect())) == {"a": 8 + 8 + 8192, "b": 8 + 8 + 8192, "c": 8 + 8 + 8192}


def test_questions_in_bulk(spark):
    c = files(spark, [("a", "the fetch function reads"), ("b", "fetc other"), ("c", "nothing")])
    asked = spark.createDataFrame([(1, "where is the fetch function"), (2, "what about it"), (3, "othr")], "query_id int, question string")
    found = evaluate.answers(c, asked)
    assert {(r.query_id, r.position) for r in found.collect()} == {(1, 1), (1, 2), (1, 4), (3, 5)}
    for q in asked.collect():
        one = {r.position: round(r.confidence, 9) for r in c.search(q.question).collect()}
        assert {r.position: round(r.confidence, 9) for r in found.where(F.col("query_id") == q.query_id).collect()} == one
    truth = spark.createDataFrame([(1, 0), (3, 2)], "query_id int, doc_id long")
    assert {tuple(r) for r in evaluate.answered(found, truth, asked).collect()} == {(1, 3, 2, 2, 1), (2, 0, 0, 0, 0), (3, 1, 0, 1, 0)}
    out, took = evaluate.timed(["fetch", "x"], lambda q: c.search(q).count())
    assert out[0] == 2 and took["total_s"] >= took["max_s"] >= took["mean_s"] > 0


def test_validation(spark):
    rows = [("fn main() { let x = 42; }", True, 0.0), ("fn main( { broken code", False, -0.4), ("cut...", True, -0.15), ("", True, 0.0), ("a;\r\n", True, 0.0), ("x\n\n", True, 0.0)]
    got = context.validated(spark.createDataFrame([(t,) for t, _, _ in rows], "text string")).collect()
    assert [(r.text, r.syntax_valid, r.confidence_adjustment) for r in got] == rows
    checks = context.context_checks(spark.createDataFrame([(1, "a { b"), (5, "cut...")], "position long, snippet string")).first()
    assert (checks.balanced_braces, checks.no_truncated_tokens, checks.issues) == (False, False, ["Truncated token at position 5", "Unbalanced braces: 1 open, 0 close"])


def test_feedback(spark):
    rows = [("q", i, i >= 5) for i in range(15)] + [("r", 0, True), ("r", 1, False)]
    got = {r["query"]: r.confidence for r in context.feedback(spark.createDataFrame(rows, "query string, seq long, valid boolean")).collect()}
    assert got == {"q": 1.0, "r": 0.5}


def test_feedback_state(spark, tmp_path):
    spark.createDataFrame([("q", i >= 5) for i in range(15)], "query string, valid boolean").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream_ = spark.readStream.schema("query string, valid boolean").parquet(f"file://{tmp_path}/in")
    q = hot_cold.last_feedback(stream_).writeStream.format("memory").queryName("feedback_state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT query, confidence, n FROM feedback_state").collect()[-1] == ("q", 1.0, 10)


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT tokenize('a_b c') AS t, split_words('fetchURLNow') AS s, fnv1a64('a') AS h, parse_query('auth chain') AS p, levenshtein_within('ab', 'ac', 1) AS l, split_identifier('a::bC') AS i, lex_code('x \"s\"') AS c").first()
    assert (row.t, row.s, row.h, row.p, row.l, row.i, row.c) == (["a", "b", "c"], ["fetch", "url", "now"], "af63dc4c8601ec8c", [["auth", "chain"], ["auth"], ["chain"]], True, ["a", "b", "c"], ["x", "STR"])
    assert [r.position for r in spark.sql("SELECT * FROM phrase_positions('a b a b', 'a b')").collect()] == [0, 2]
