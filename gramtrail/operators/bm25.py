"""BM25 ranking of files."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus

K1, B = 1.5, 0.75


def scores(corpus: Corpus, words: list[str], variant: str = "reference") -> DataFrame:
    """doc_id and score of every file with one of the words.

    reference: collection frequency in the place of document frequency, and a term's weight once for each occurrence;
    okapi: document frequency and one weight a term. A word given twice counts twice.
    """
    asked = corpus.spark.createDataFrame(list(Counter(words).items()) or [("", 0)], "token string, times int")
    tf = corpus.tokens.where(F.col("token").isin(list(words))).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    size = corpus.files.agg(F.count("*").alias("n"), F.avg("token_count").alias("avgdl"))
    rows = tf.join(F.broadcast(asked), "token").join(df, "token").join(corpus.files.select("doc_id", "token_count"), "doc_id").crossJoin(F.broadcast(size))  # one row of totals
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("token_count") / F.col("avgdl")))
    if variant == "reference":
        idf = F.when(2 * F.col("cf") < F.col("n"), F.log((F.col("n") - F.col("cf") + 0.5) / (F.col("cf") + 0.5))).otherwise(0.0)
        one = F.col("tf") * idf * norm
    else:
        idf = F.when(2 * F.col("df") < F.col("n"), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).otherwise(0.0)
        one = idf * norm
    return rows.groupBy("doc_id").agg(F.sum(one * F.col("times")).alias("score"))


def search(corpus: Corpus, words: list[str], k: int = 10, variant: str = "reference") -> DataFrame:
    """The k best files; equal scores by the smaller id."""
    return scores(corpus, words, variant).orderBy(F.desc("score"), "doc_id").limit(k)
