"""The stages in a row, and each on unusual tables."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gramtrail.llm import secret_crf, winnow
from gramtrail.llm.queries import tokenizer_path

from ..conftest import DATA
from .test_operators import brute_components


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    df, after = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.written(stage(spark, df, str(DATA)), "test")
        after[name] = df
    one, two, three, four, five = after.values()
    for x in (one, two, three, four):
        assert x.columns == docs.columns
    groups = brute_components([(r.doc_id, r.text) for r in one.collect()], 5, 80)
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, c in groups.values()})
    assert three.count() == two.count() - winnow.decontaminate(two, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").count()
    assert four.count() == three.count() == five.count()
    texts = {(r.doc_id, r.text) for r in four.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert sorted((r.doc_id, *r.ids) for r in five.collect()) == sorted((i, *lib.encode(t or "", add_eos=True)) for i, t in texts)
    had = {r.doc_id for r in three.collect() if secret_crf.base_spans(r.text or "")}
    left = four.collect()
    assert had and had <= {r.doc_id for r in left if "[SECRET]" in (r.text or "")} and not any(secret_crf.base_spans(r.text or "") for r in left)
    assert corpus_pipeline.run(spark, str(DATA)).count() == five.count()


@pytest.mark.parametrize("k", range(5))
def test_edges(spark, edge, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars", "score")
    got = stage(spark, plain, str(DATA))
    assert got.count() >= 10
    if k < 4:
        assert got.columns == plain.columns
    assert stage(spark, none, str(DATA)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    """Many benchmark items only mean more passes, and columns of any name stay as they are."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("__row", F.lit("r")).withColumn("__key", F.lit("u"))
    one = corpus_pipeline.decontamination(spark, docs, str(DATA))
    monkeypatch.setattr(winnow, "INDEX_BYTES", 2000)
    many = corpus_pipeline.decontamination(spark, docs, str(DATA))
    assert many.columns == one.columns == docs.columns
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect())) and 0 < one.count() < docs.count()
    direct = winnow.decontaminate(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert {(r["__row"], r["__key"]) for r in direct.collect()} == {("r", "u")}
