"""What is shuffled grows with the texts or the hits, and not with the tokens."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gramtrail import Corpus
from gramtrail.operators import context, evaluate, hybrid, phrase
from gramtrail.plans import catalogue
from gramtrail.sources import store

TEXTS = ["one two\n\nthree one", "", None, "Über-größe 東京 x", "\n\none", "two " * 300 + "\nend", "...", "One two\r\nTWO"]


def shuffled(spark, run):
    """Rows that a job shuffles, where no join is a broadcast."""
    jvm, known = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    rows = lambda: sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(known.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    name = "spark.sql.autoBroadcastJoinThreshold"
    old, before = spark.conf.get(name), rows()
    spark.conf.set(name, "-1")
    try:
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return rows() - before
    finally:
        spark.conf.set(name, old)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, " ".join(f"w{i * j % 50}" for j in range(200))) for i in range(60)], "doc_id long, text string")


def test_tokens_are_made_where_the_texts_are(spark, docs):
    c = Corpus.from_files(docs)
    assert shuffled(spark, lambda: c.tokens.write.format("noop").mode("overwrite").save()) < 1_000 < 12_000 == c.tokens.count()


def test_a_save_shuffles_no_tokens(spark, docs, tmp_path):
    c, at = Corpus.from_files(docs).persisted(), f"file://{tmp_path}/index"
    c.tokens.count()
    assert shuffled(spark, lambda: store.save(c, at)) < 1_000
    assert sorted(map(tuple, store.load(spark, at).tokens.collect())) == sorted(map(tuple, c.tokens.collect()))
    c.tokens.unpersist(), c.base.unpersist()


@pytest.mark.parametrize("kind", ["core", "agent"])
def test_places_by_files_are_those_by_tokens(spark, tmp_path, kind):
    c = Corpus.from_files(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), kind=kind)
    store.save(c, f"file://{tmp_path}/index")
    want = {(r.pos, r.token) for r in c.tokens.collect()}
    asked = spark.range(0, len(want) + 5).select(F.col("id").alias("pos"))
    for own in (c, store.load(spark, f"file://{tmp_path}/index"), c.update(spark.createDataFrame([(2, None)], "doc_id long, text string"))):
        assert own.filed
        for few in (False, True):
            assert {(r.pos, r.token) for r in own.looked_up(asked, few).collect()} == want
        wide = own.looked_up(asked.crossJoin(spark.range(3)), False)
        assert wide.count() == 3 * len(want)
    lines = {(i, n + 1, line) for i, t in enumerate(TEXTS) for n, line in enumerate((t or "").split("\n"))}
    places = spark.createDataFrame([(i, n) for i, n, _ in lines] * 2 + [(None, 1), (0, 99), (77, 1)], "doc_id long, line_no int")
    for few in (False, True):
        assert {tuple(r) for r in c.lines_at(places, few).where("line is not null").collect()} == lines


def test_many_places_shuffle_no_tokens(spark, docs):
    c = Corpus.from_files(docs).persisted()
    c.tokens.count()
    hits = phrase.positions(c, ["w7"]).limit(20).localCheckpoint()
    around = hits.select(F.col("position").alias("pos"))
    assert shuffled(spark, lambda: c.looked_up(around, False).collect()) < 1_000
    c.tokens.unpersist(), c.base.unpersist()


def test_chunks_are_counted_without_their_text(spark, docs):
    c = Corpus.from_files(docs).persisted()
    c.tokens.count()
    for terms in (["w7"], ["W1", "w49"], ["nosuchword"]):
        assert shuffled(spark, lambda: evaluate.retrieved(c, terms, 5, 100).collect()) < 1_000
        text = F.lower("text")
        want = {r.chunk_id: (r.n, r.h) for r in evaluate.chunks(c, 100).select("chunk_id", "n", sum((text.contains(t.lower()).cast("int") for t in terms), F.lit(0)).alias("h")).where("h > 0").collect()}
        got = evaluate.retrieved(c, terms, 1000, 100).collect()
        assert {r.chunk_id: r.n for r in got} == {k: n for k, (n, _) in want.items()} and all(abs(r.score - want[r.chunk_id][1] / 2) < 1e-9 for r in got)
    assert evaluate.retrieved(c, ["w0 w1"], 5, 100).columns == ["chunk_id", "n", "score"]
    c.tokens.unpersist(), c.base.unpersist()


def test_what_is_stored_is_counted_without_positions(spark, docs, tmp_path):
    at = f"file://{tmp_path}/index"
    store.save(Corpus.from_files(docs), at)
    seen = {}
    assert shuffled(spark, lambda: seen.update(store.storage_stats(spark, at))) < 2_000
    assert (seen["total_tokens"], seen["unique_tokens"], seen["n_files"]) == (12_000, 50, 60)
    store.update(spark, at, spark.createDataFrame([(0, "v x"), (1, ""), (2, "w1 w2"), (90, "y")], "doc_id long, text string"))  # w0 stays in other files
    store.import_tokens(spark, at, spark.createDataFrame([("z", 0), ("w1", 1)], "token string, pos long"))
    seen, c = store.storage_stats(spark, at), store.load(spark, at)
    assert (seen["total_tokens"], seen["unique_tokens"], seen["n_files"]) == (c.tokens.count(), c.tokens.select("token").distinct().count(), c.files.count())


def test_layouts_shuffle_tokens_once(spark, docs, tmp_path):
    c, at = Corpus.from_files(docs).persisted(), f"file://{tmp_path}/index"
    c.tokens.count()
    assert shuffled(spark, lambda: store.save(c, at, layouts=True)) < 2 * 12_000  # by position
    back = store.load(spark, at)
    assert sorted(map(tuple, back.sequence.collect())) == sorted((r.pos, r.token) for r in c.tokens.collect())
    assert sorted(map(tuple, back.lexicon.collect())) == sorted(map(tuple, c.lexicon.collect()))
    c.tokens.unpersist(), c.base.unpersist()


def test_repeated_ngrams_are_sorted_once(spark):
    texts = ["x y " * 150 + "q", *[f"x y w{i}" for i in range(10)]]
    c = Corpus.from_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).persisted()
    tokens = " ".join(texts).split()
    grams = lambda w: list(zip(w, w[1:], strict=False))
    times, places = Counter(grams(texts[0].split())), Counter(grams(tokens))
    want = sum(n * places[g] for g, n in times.items())
    got = []
    assert shuffled(spark, lambda: got.extend(hybrid.search(c, "q zz", 2, "literal").collect())) < 5_000 < 40_000 < want == len(got)
    assert [(r.rank, r.position) for r in got] == sorted((r.rank, r.position) for r in got)
    assert Counter((r.position, r.phrase) for r in got) == Counter({(i, " ".join(g)): times[g] for i, g in enumerate(grams(tokens)) if g in times})
    assert hybrid.literal(c, "q zz", 2).count() == hybrid.results(c, "q zz", 2, "literal").count() == want
    c.tokens.unpersist(), c.base.unpersist()


def test_questions_shuffle_no_results(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = ["w1 w2 w3 w4 x", "w0 w0 w0 w0", "w49 nosuchword W1", "", None]
    spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = catalogue.corpus(spark, str(tmp_path))
    c.tokens.count()
    got = []
    assert shuffled(spark, lambda: got.extend(catalogue.QUERIES["question_answers"](spark, str(tmp_path)).collect())) < 2_000
    by = {r.query_id: r for r in got}
    assert sum(r.n_results for r in got) > 12_000 and by["i3"].n_results == by["i4"].n_results == 0
    for i, t in enumerate(items[:3]):
        one = c.search(" ".join(t.split()[:3])).collect()
        assert (by[f"i{i}"].n_results, by[f"i{i}"].n_exact, by[f"i{i}"].n_files) == (len(one), sum(r.confidence == 1.0 for r in one), len({r.file_path for r in one}))
    c.tokens.unpersist(), c.base.unpersist()


@pytest.mark.parametrize("window,budget,strict", [(5, 100, False), (5, 7, True), (70_000, 40, False), (0, 10**6, False)])
def test_windows_are_numbered_without_their_places(spark, docs, window, budget, strict):
    c = Corpus.from_files(docs).persisted()
    total = c.tokens.count()
    hits = phrase.positions(c, ["w7"]).select("position").localCheckpoint()
    at = sorted(r.position for r in hits.collect())
    config, got = context.PromptConfig(max_context_tokens=budget, window=window, strict_budget=strict), []
    # Neither a shuffle nor a broadcast has a row for each place of a window.
    assert shuffled(spark, lambda: got.extend(context.relevant_positions(c, hits, config).collect())) < 4 * len(at) + 200
    places = sorted({p for h in at for p in range(max(h - window, 0), min(h + window + 1, total))})
    step = max(-(-len(places) // budget) if strict else len(places) // budget, 1)
    words = {r.pos: r.token for r in c.tokens.collect()}
    assert sorted((r.pos, r.token) for r in got) == [(p, words[p]) for p in places[::step]]
    c.tokens.unpersist(), c.base.unpersist()


def test_few_hits_are_no_wide_broadcast(spark, docs, monkeypatch):
    c = Corpus.from_files(docs)
    asked, own = [], Corpus.looked_up
    monkeypatch.setattr(Corpus, "looked_up", lambda self, around, few: asked.append((around.count(), few)) or own(self, around, few))
    context.relevant_positions(c, phrase.positions(c, ["w7"]), context.PromptConfig(max_context_tokens=10)).collect()
    assert asked == [(n, True) for n, _ in asked] and all(n < 20 for n, _ in asked)


def test_a_prompt_shuffles_hits_and_words(spark, docs):
    c = Corpus.from_files(docs).persisted()
    c.tokens.count()
    got = []
    assert shuffled(spark, lambda: got.append(context.build_prompt(c, "w9x", [["w7"]], context.PromptConfig(max_context_tokens=10)).first())) < 1_200
    places = sorted({p for r in c.tokens.collect() if r.token in ("w7", "w9") for p in range(max(r.pos - 5, 0), min(r.pos + 6, 12_000))})  # w9 is near w9x
    assert got[0].original_token_count == 12_000 and got[0].prompt_tokens[1:-4:2] == [f"[{p}]" for p in places[:: len(places) // 10]]
    c.tokens.unpersist(), c.base.unpersist()


def test_segments_are_read_by_their_texts(spark, docs, tmp_path):
    at, rows = f"file://{tmp_path}/index", docs.select(F.format_string("p%02d", "doc_id").alias("path"), "text", "doc_id")
    for part in (rows.where("doc_id < 25"), rows.where("doc_id >= 25")):
        c = store.append(spark, at, part, order="doc_id")
    names = ["token", "pos", "doc_id", "local_pos", "line_no", "next", "path"]
    rows = lambda df: sorted(map(repr, df.select(*names).collect()))
    got = []
    assert shuffled(spark, lambda: got.extend(rows(c.all_tokens("path")))) < 1_000 < 12_000 == len(got)
    for change in (None, lambda: store.update(spark, at, spark.createDataFrame([(0, "é x\n\nw1"), (7, None), (90, "y")], "doc_id long, text string")), lambda: store.import_tokens(spark, at, spark.createDataFrame([("z", 0), ("w1", 1)], "token string, pos long"))):
        c = change() if change else c
        assert rows(c.all_tokens("path")) == rows(c.tokens.join(c.files.select("doc_id", "path"), "doc_id", "left"))
    assert c.texts is None and rows(Corpus.from_files(docs).all_tokens("path")) == rows(Corpus.from_files(docs).tokens.withColumn("path", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("kind", ["core", "agent"])
def test_layouts_shuffle_texts_and_words(spark, docs, tmp_path, kind):
    c, at = Corpus.from_files(docs, kind=kind).persisted(), f"file://{tmp_path}/index"
    c.tokens.count()
    assert shuffled(spark, lambda: store.save(c, at, layouts=True)) < 6_000 < 12_000
    back = store.load(spark, at)
    assert sorted(map(tuple, back.sequence.collect())) == sorted((r.pos, r.token) for r in c.tokens.collect())
    folder = store.manifest(spark, at)["layouts"]["sequence"]
    by_file = spark.read.parquet(f"{at}/{folder}").withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b - r.a + 1 == r.n for r in by_file)  # each file is one range of positions
    size = sum(f.stat().st_size for f in (tmp_path / "index" / folder).glob("*.parquet"))
    assert size < 3 * 12_000  # positions take less than a few bits
    asked = spark.createDataFrame([(3, 1), (40, 1)], "doc_id long, line_no int")
    got = []
    assert shuffled(spark, lambda: got.extend(back.lines_at(asked, True).collect())) <= 70  # two texts and the rows of live
    assert sorted(map(tuple, got)) == sorted(map(tuple, c.lines_at(asked, True).collect()))
    c.tokens.unpersist(), c.base.unpersist()


def test_an_append_leaves_no_copy(spark, docs, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folders = lambda: set(Path(shared.removeprefix("file://")).glob("*"))
    before = folders()
    c = store.append(spark, f"file://{tmp_path}/index", docs.select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id"), order="doc_id")
    assert folders() == before and c.tokens.count() == 12_000
