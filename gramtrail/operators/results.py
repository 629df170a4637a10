"""Result rows: position, context, confidence, file_path, line_number, line_content, highlighted_snippet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import Corpus

COLUMNS = ["position", "context", "confidence", "file_path", "line_number", "line_content", "highlighted_snippet"]


def weighed(corpus: Corpus, hits: DataFrame, base: Column) -> DataFrame:
    """The hits with their confidence, base and the file's weight, and file_path."""
    files = corpus.files.select("doc_id", F.col("path").alias("file_path"), F.col("token_count").alias("__n"))
    return hits.join(files, "doc_id", "left").withColumn("confidence", base + F.coalesce(X.file_weight(F.col("__n")), F.lit(0.0))).drop("__n")


def enriched(corpus: Corpus, hits: DataFrame, base: Column, context: Column, needles: list[Column], keep: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Result rows of hits(position, doc_id, line_no, ...); base is the confidence before the file's weight. few says that the hits are settled and few."""
    lines = corpus.lines_at(hits.select("doc_id", "line_no"), few).withColumnRenamed("line", "line_content")  # only those that are shown
    found = weighed(corpus, hits, base).join(lines, ["doc_id", "line_no"], "left")
    return found.select(
        "position", context.alias("context"), "confidence", "file_path", F.col("line_no").alias("line_number"), "line_content",
        F.when(F.col("line_content").isNotNull(), X.highlight(F.col("line_content"), needles)).alias("highlighted_snippet"), *keep,
    )


def windows(corpus: Corpus, hits: DataFrame, before: int, after: int, out: str, few: bool = False) -> DataFrame:
    """The hits with the tokens at [position - before, position + after), joined by spaces."""
    near = corpus.near(hits, before, after, few=few).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("__t"))  # a window's tokens
    return hits.join(near, "position", "left").withColumn(out, F.array_join(F.transform(F.coalesce("__t", F.array().cast("array<struct<pos:bigint,token:string>>")), lambda t: t["token"]), " ")).drop("__t")
