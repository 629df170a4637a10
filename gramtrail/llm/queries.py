"""The queries of the operators in this folder, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES
from .textops import crc_mod

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer's file; it is read where it lies."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity_ftrl as tox

    docs = table(spark, sf_dir, "documents")
    model = tox.train(docs, table(spark, sf_dir, "labels"), only=crc_mod("doc_id", 5) != 0)
    scored = tox.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import winnow

    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe_backtrack

    return bpe_backtrack.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_crf

    docs = table(spark, sf_dir, "documents")
    return secret_crf.scan(docs, secret_crf.train(docs), keep=["doc_id"])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import va_topk

    return va_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import interleave

    out = interleave.interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie_lm

    out = trie_lm.lm_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import span_dedup

    return span_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), sentences=None)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii_lstm

    docs = table(spark, sf_dir, "documents")
    return pii_lstm.scan(docs, pii_lstm.train(docs), keep=["doc_id"])


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_trie

    return conversation_trie.trie(table(spark, sf_dir, "conversations"), rebuild=True).drop("n_ends")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import runs

    return runs.find(table(spark, sf_dir, "documents"), keep=["doc_id"], seed=F.crc32(F.col("doc_id").cast("string").cast("binary")), digests=True)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_gam as gam

    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs, table(spark, sf_dir, "labels"), only=crc_mod("doc_id", 4) != 2)
    scored = gam.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_secrets, op3_toxicity, op4_topk, op5_decontaminate, op6_shards, op7_lm_scores, op8_span_dedup, op9_pii, op10_sentencepiece, op11_conversation_trie, op12_periodic_runs, op13_quality)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
