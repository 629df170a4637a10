"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

Repeated rows stay repeated but for the dedup stage, which keeps one; rows without an id are never
duplicates; a null or empty text passes every filter and ends as its end id alone; texts of any length are read whole; extra columns of the
documents go along, whatever their names, but give way to those of the last stage; of an empty table no rows come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramtrail.llm import bpe_backtrack, jaccard_join, secret_crf, toxicity_ftrl, winnow
from gramtrail.llm.queries import table, tokenizer_path
from gramtrail.llm.shared import written
from gramtrail.llm.textops import free_name


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject."""
    model = toxicity_ftrl.train(docs, table(spark, sf_dir, "labels"))
    name = free_name("__toxic", docs.columns)
    return _columns(toxicity_ftrl.score(docs, model, name=name).where(F.col(name) < 0.5), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: five words a shingle, similarity 0.8 or more."""
    return jaccard_join.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"))  # names of columns cannot clash inside
    found = winnow.decontaminate(row, table(spark, sf_dir, "benchmark"), keep=["text", "__row"]).where("NOT contaminated")
    return found.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    out = secret_crf.redact(docs, secret_crf.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, how many there are, and digests of them and of the decoded text."""
    return bpe_backtrack.round_trip(docs, tokenizer_path(), keep=[c for c in docs.columns if c not in ("text", "n_chars")], ids=True)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("secret_scan", secrets), ("sentencepiece", sentencepiece)]

#: SQL cannot express the trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
