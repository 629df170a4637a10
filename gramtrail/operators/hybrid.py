"""Ranking and positions together: BM25 picks files, positions in them are the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import questions
from . import bm25, phrase
from .corpus import Corpus, bounded, settled
from .results import enriched

#: How often a row that is sorted stands in the result at most.
REPEATS = 64


def candidates(corpus: Corpus, question: str, k: int) -> DataFrame:
    """doc_id, score and rank of the k best files of a question's words."""
    best = bm25.search(corpus, questions.hybrid_words(question), k)
    return bounded(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))))  # k rows, which are ranked once


def documented(corpus: Corpus, question: str, k: int = 10) -> DataFrame:
    """doc_id, position, line_no, phrase and confidence of the question's phrases inside the best files."""
    best = candidates(corpus, question, k)
    phrases = questions.parse(question)
    inside = Corpus(corpus.files, corpus.tokens.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi"), corpus.kind)  # k rows
    hits = phrase.match(inside, phrase.terms_of(corpus, phrases), within_file=True, few=True).join(F.broadcast(best), "doc_id")  # k rows
    name = F.get(F.array(*[F.lit(" ".join(p)) for p in phrases]), F.col("phrase_id"))
    return hits.select("doc_id", "position", name.alias("phrase"), (0.7 + F.least(0.3 * F.col("score"), F.lit(0.3))).alias("confidence"), "score", "rank", "line_no")


def literal(corpus: Corpus, question: str, k: int = 2) -> DataFrame:
    """Each n-gram of each best file (n words, as the question has), with all places where it occurs in the corpus.

    n-grams are made within the k files; repeated n-grams repeat their rows.
    """
    return _repeated(_places(corpus, question, k))


def _places(corpus: Corpus, question: str, k: int) -> DataFrame:
    """The rows of literal(), each once, with how often it stands there (times)."""
    n = len(questions.hybrid_words(question))
    best = candidates(corpus, question, k)
    words = corpus.tokens.join(F.broadcast(best), "doc_id").groupBy("doc_id", "score", "rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]).alias("w"))  # the tokens of a file
    grams = words.where(F.size("w") >= n).select("doc_id", "score", "rank", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n))).alias("g"))
    grams, few = settled(grams.groupBy("doc_id", "score", "rank", "g").agg(F.count("*").alias("times")))  # the n-grams of k files, which are made once
    terms = grams.select("g").distinct().select(F.array_join("g", " ").alias("phrase_id"), F.lit(n).alias("k"), F.posexplode("g").alias("off", "token"))
    named = grams.withColumn("phrase", F.array_join("g", " "))
    hits = phrase.match(corpus, terms).select(F.col("phrase_id").alias("phrase"), "position", "line_no").join(F.broadcast(named) if few else named, "phrase")
    return hits.select("doc_id", "position", "line_no", "phrase", (0.7 + F.least(0.3 * F.col("score"), F.lit(0.3))).alias("confidence"), "score", "rank", "times")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows as often as times says, each after the other."""
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("__i", "times")


def _in_order(rows: DataFrame, *keys) -> DataFrame:
    """_repeated() in a global order. Rows are sorted before they are repeated, in shares of a bounded number, so that ranges of as many rows give results of like size."""
    if "times" not in rows.columns:
        return rows.orderBy(*keys)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the size of what is sorted does not tell that of the result
    shares = rows.repartition(n, "rank", "position").withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(REPEATS)))).withColumn("times", F.least(F.col("times") - F.col("__from"), F.lit(REPEATS))).drop("__from")  # dealt out once, as the bounds of ranges are sampled in passes of their own, which would each search the tokens again
    return _repeated(shares.repartitionByRange(n, *keys).sortWithinPartitions(*keys))


def search(corpus: Corpus, question: str, k: int = 10, mode: str = "documented") -> DataFrame:
    """Either of the two; a question without words gives nothing. Where no file holds a word use search.search()."""
    if not questions.hybrid_words(question):
        return documented(corpus, "x", 0).drop("line_no")
    return _in_order(_found(corpus, question, k, mode).drop("line_no"), F.desc("confidence"), "rank", "position")


def _found(corpus: Corpus, question: str, k: int, mode: str) -> DataFrame:
    return _places(corpus, question, k) if mode == "literal" else documented(corpus, question, k)


def results(corpus: Corpus, question: str, k: int = 10, mode: str = "documented") -> DataFrame:
    """Result rows of search(), with the file's number and score in the context."""
    rows = _found(corpus, question if questions.hybrid_words(question) else "x", k, mode).withColumnRenamed("confidence", "__c")
    context = F.format_string("[DOC %d] [POS %d] BM25=%.2f | '%s'", "doc_id", "position", "score", "phrase")
    shown = enriched(corpus, rows, F.lit(0.0), context, [F.element_at(F.split("phrase", " "), 1)], ("__c", "rank", *(["times"] if "times" in rows.columns else [])))
    return _in_order(shown.withColumn("confidence", F.col("__c")), F.desc("confidence"), "rank", "position").drop("__c", "rank")


def or_search(corpus: Corpus, question: str, k: int = 10) -> DataFrame:
    """The documented results, or those of the plain question search where no file ranks."""
    from .search import search as plain

    if not questions.hybrid_words(question) or candidates(corpus, question, 1).isEmpty():
        return plain(corpus, question).select("position", "confidence")
    return documented(corpus, question, k).select("position", "confidence")
