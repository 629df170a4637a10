"""Behaviour of corpora and searches on small inputs."""

import math
import random

import pytest

from gramtrail import Corpus
from gramtrail.functions import text as X
from gramtrail.functions.code_lexer import lex
from gramtrail.operators import agent, bm25, evaluate, hybrid, phrase
from gramtrail.plans import questions
from gramtrail.sources.files import token_list

from .conftest import positions

DEMO = "fn fetch data url str Result Vec u8 let conn".split()


def stream(spark, text):
    return Corpus.from_tokens(token_list(spark, text.split()))


def files(spark, rows, kind="core"):
    return Corpus.from_files(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string"), "doc_id", "text", "path", kind)


@pytest.mark.parametrize(("text", "words", "wants"), [
    ("fn main ( ) {", ["fn", "main"], [0]), ("fn main ( ) {", ["fn", "not_here"], []), ("fn a fn b fn a", ["fn", "a"], [0, 4]), ("fn main ( ) { fn main (", ["fn", "main"], [0, 5]), ("a a a", ["a", "a"], [0, 1]), ("a b", [], []),
])
def test_phrase(spark, text, words, wants):
    c = stream(spark, text)
    assert positions(phrase.positions(c, words)) == wants
    if len(words) > 1:
        assert positions(phrase.intersected(c, words)) == wants


def test_file_results(spark):
    c = files(spark, [("src/auth.rs", "fn authenticate(user: &str) -> Result<(), Error> {\n    Ok(())\n}\n")])
    (r,) = c.phrase(["fn", "authenticate"]).collect()
    assert (r.position, r.file_path, r.line_number) == (0, "src/auth.rs", 1)
    assert math.isclose(r.confidence, 1 + 0.01 * math.log10(7))
    assert r.highlighted_snippet.startswith("**fn** authenticate")
    assert [t.token for t in c.tokens.orderBy("pos").collect()] == "fn authenticate user str Result Error Ok".split()
    assert [t.line_no for t in c.tokens.orderBy("pos").collect()] == [1, 1, 1, 1, 1, 1, 2]


def test_file_borders(spark):
    c = files(spark, [("a", "x y"), ("b", "z w"), ("c", ""), ("d", "x y")])
    (r,) = c.phrase(["y", "z"]).collect()
    assert (r.position, r.file_path) == (1, "a")
    assert c.phrase(["y", "z"], within_file=True).count() == 0
    assert positions(c.phrase(["x", "y"])) == [0, 4]
    assert [(f.path, f.token_start, f.token_end) for f in c.file_stats().orderBy("doc_id").collect()] == [("a", 0, 2), ("b", 2, 4), ("c", 4, 4), ("d", 4, 6)]
    assert [r.doc_id for r in c.overlapping(2, 3).collect()] == [1]


@pytest.mark.parametrize(("text", "word", "d", "wants"), [
    ("execute", "execut", 2, [(0, "execute", 1)]), ("lot", "let", 1, []), ("let", "let", 1, []), ("records recors", "recors", 2, [(0, "records", 1)]), ("fetch let Vec", "fetc", 2, [(0, "fetch", 1)]),
])
def test_fuzzy(spark, text, word, d, wants):
    got = stream(spark, text).fuzzy(word, d).collect()
    assert sorted((r.position, r.token, r.dist) for r in got)[: len(wants) or None] == wants
    assert all(math.isclose(r.confidence, 1 - r.dist / (d + 1)) for r in got)


def test_fuzzy_prefilter_and_bytes(spark):
    c = stream(spark, "lot café naïve")
    assert positions(c.fuzzy("let", 1, prefilter=False)) == [0]
    assert [r.dist for r in c.fuzzy("cafe", 1).collect()] == [1]
    asked = spark.createDataFrame([("cafe",), ("naive",), ("zz",)], "query string")
    assert sorted((r.query, r.token) for r in c.fuzzy_join(asked, 1).collect()) == [("cafe", "café"), ("naive", "naïve")]


def test_questions(spark):
    c = stream(spark, "execute query database")
    (r,) = c.search("where is the execut method").collect()
    assert (r.position, r.confidence) == (0, 0.25)
    assert c.search("the a is").count() == 0
    got = stream(spark, "fn fetch data from url").search("where is the fetch data function").collect()
    assert got[0].confidence == 1.0 and [g.confidence for g in got] == sorted((g.confidence for g in got), reverse=True)


@pytest.mark.parametrize("question", ["how does the auth middleware chain work", "std::collections::HashMap usage", "the a is", "getURL HTTPSConnection x y", "it's a let's_go work.", "", "a_b cd-ef Vec<String> Result<T, E>"])
def test_parser_column_and_text_agree(spark, question):
    row = spark.createDataFrame([(question,)], "q string").select(X.search_phrases(X.F.col("q")).alias("p")).first()
    assert [list(p) for p in row.p] == questions.parse(question)


def test_parser():
    assert questions.parse("how does the auth middleware chain work") == [["auth", "middleware", "chain", "work"], ["auth"], ["middleware"], ["chain"], ["work"]]
    assert questions.parse("std::collections::HashMap usage") == [["std", "collections", "hash", "map"], ["usage"], ["std"], ["collections"], ["hash"], ["map"], ["usage"]]
    wants = {"fetchData": "fetch data", "HTTPSConnection": "https connection", "getURL": "get url", "Simple": "simple", "XMLParser": "xml parser", "fetch_data": "fetch data", "auth-middleware": "auth middleware", "tokio::sync::Mutex": "tokio sync mutex", "Vec<String>": "vec string", "Result<T, E>": "result t e"}
    assert {w: " ".join(questions.split_identifier(w)) for w in wants} == wants
    assert len(X.STOP_WORDS) == 130


def test_bm25(spark):
    c = files(spark, [(str(i), t) for i, t in enumerate(["a b a c", "c d", "d e", "e f", "f c"])])
    assert [(r.doc_id, round(r.score, 6)) for r in c.bm25(["a"]).collect()] == [(0, 0.791699)]
    assert [(r.doc_id, round(r.score, 6)) for r in c.bm25(["a"], variant="okapi").collect()] == [(0, round(math.log(3) * 1.1764705882, 6))]
    assert sorted((r.doc_id, r.score) for r in c.bm25(["c"]).collect()) == [(0, 0.0), (1, 0.0), (4, 0.0)]
    assert c.bm25(["zz"]).count() == 0
    assert math.isclose(bm25.scores(c, ["a", "a"]).first().score, 2 * 0.7916987, rel_tol=1e-5)


def test_hybrid(spark):
    c = files(spark, [("0", "connect to database now"), ("1", "open database"), ("2", "x"), ("3", "y"), ("4", "z")])
    got = c.hybrid("connect database").collect()
    assert {(r.doc_id, r.position, r.phrase) for r in got} == {(0, 0, "connect"), (0, 2, "database"), (1, 5, "database")}
    assert all(0.7 <= r.confidence <= 1 for r in got)
    assert c.hybrid("nonexistent").count() == 0 and hybrid.or_search(c, "nonexistent").count() == 0
    assert {(r.position, r.phrase) for r in c.hybrid("connect database", 5, "literal").collect()} >= {(0, "connect to"), (4, "open database")}


def test_line_functions(spark):
    F = X.F
    row = spark.createDataFrame([("line1\nline2\nline3\n", "")], "a string, b string").select(X.line_offsets(F.col("a")).alias("o"), X.line_at(F.col("a"), F.lit(2)).alias("l"), X.line_at(F.col("a"), F.lit(9)).alias("n"), X.line_offsets(F.col("b")).alias("e"), X.fnv1a64(F.lit("a")).alias("h"), X.fnv1a64(F.lit("")).alias("z"), X.highlight(F.lit("ab.c ab"), [F.lit("."), F.lit("ab")]).alias("b")).first()
    assert (row.o, row.l, row.n, row.e, row.h, row.z, row.b) == ([0, 6, 12, 18], "line2", "", [0], "af63dc4c8601ec8c", "cbf29ce484222325", "ab**.**c ab")


def test_code_lexer():
    assert lex('let s = "a b"; // x\nr#"raw"# \'c\' a->b x+=1 /* y */') == ["let", "s", "=", "STR", ";", "RAW_STR", "CHAR", "a", "->", "b", "x", "+=", "1"]


def test_agent(spark):
    t = agent.Tools(spark)
    t.index_file("a.rs", "Fn Main here\nfn main again fn main")
    t.index_text("other text")
    assert "=== a.rs (3 matches) ===" in t.phrase_search("FN main")
    assert "a.rs" in t.fuzzy_search("maim") and t.fuzzy_search("q") == "No fuzzy matches found."
    assert "a.rs" in t.search("where is the main") and t.phrase_search("nothing") == "No matches found."
    assert "Files indexed: 2" in t.get_stats() and t.get_file_content("(text)") == "other text"
    assert t.clear_index() == "Index cleared."
    c = files(spark, [("a", "alpha beta alpha")], "agent")
    assert [(r.token, r.position, r.dist) for r in agent.fuzzy_hits(c, "alpha").collect()] == [("alpha", 0, 0)]
    (w,) = agent.context(c, agent.phrase_hits(c, ["beta"]), 1).collect()
    assert w.context == "alpha beta ..."


def test_evaluation(spark):
    c = stream(spark, " ".join(["x"] * 30 + ["needle"] + ["y"] * 30))
    (r,) = evaluate.refined(c, ["needle"], ["needle"], k=3, size=40).collect()
    assert (r.chunk_id, r.whole_tokens, r.injected_tokens) == (0, 40, 20)
    a, b = (spark.createDataFrame([(x,) for x in xs], "k long") for xs in ([1, 2], [2, 3, 4]))
    assert {(r.side, r.n) for r in evaluate.compared(a, b, "k").collect()} == {("both", 1), ("first", 1), ("second", 2)}


def model_phrase(tokens, words):
    k = len(words)
    return [i for i in range(len(tokens) - k + 1) if tokens[i : i + k] == words]


def model_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_against_a_plain_model(spark):
    r = random.Random(7)
    for _ in range(3):
        vocabulary = ["".join(r.choice("abé") for _ in range(r.randint(1, 4))) for _ in range(12)]
        texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in range(6)]
        c = files(spark, [(str(i), t) for i, t in enumerate(texts)])
        tokens = " ".join(texts).split()
        asked = [[r.choice(vocabulary) for _ in range(r.randint(1, 3))] for _ in range(8)]
        got = {}
        for row in c.phrases(phrase.terms_of(c, asked)).collect():
            got.setdefault(row.phrase_id, []).append(row.position)
        assert {i: sorted(p) for i, p in got.items()} == {i: p for i, w in enumerate(asked) if (p := model_phrase(tokens, w))}
        word = r.choice([v for v in vocabulary if len(v) > 1] or ["ab"])
        pairs = lambda x: {x.encode()[i : i + 2] for i in range(len(x.encode()) - 1)}
        wants = [i for i, t in enumerate(tokens) if pairs(t) & pairs(word) and abs(len(t.encode()) - len(word.encode())) <= 2 and 0 < model_distance(t, word) <= 2]
        assert positions(c.fuzzy(word, 2)) == wants
