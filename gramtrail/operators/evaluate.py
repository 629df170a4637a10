"""Evaluation: chunk retrieval, refinement to positions, recall, and comparison of two engines."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import fuzzy, phrase
from .corpus import Corpus, bounded
from .results import weighed

CHUNK = 1024


def chunks(corpus: Corpus, size: int = CHUNK) -> DataFrame:
    """chunk_id, n and text of runs of so many tokens."""
    rows = corpus.tokens.groupBy(F.floor(F.col("pos") / size).alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))  # size tokens
    return rows.select("chunk_id", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("text"))


def retrieved(corpus: Corpus, terms: list[str], k: int = 3, size: int = CHUNK) -> DataFrame:
    """chunk_id and score of the best chunks: how many terms occur in them, by the logarithm of their length."""
    if not any(len(t.split()) != 1 or t != t.strip() for t in terms):  # a term without white space lies within a token: counts alone, and no text of a chunk is made
        has = [F.max(F.lower("token").contains(t.lower()).cast("int")) for t in terms]
        own = corpus.tokens.groupBy(F.floor(F.col("pos") / size).alias("chunk_id")).agg(F.count("*").alias("n"), *[h.alias(f"__h{i}") for i, h in enumerate(has)])
        return _best(own, sum((F.col(f"__h{i}") for i in range(len(terms))), F.lit(0)), k)
    own = chunks(corpus, size)
    hits = sum((F.lower("text").contains(t.lower()).cast("int") for t in terms), F.lit(0))
    return _best(own, hits, k)


def _best(own: DataFrame, hits: Column, k: int) -> DataFrame:
    return own.select("chunk_id", "n", (hits / F.log10("n")).alias("score"), hits.alias("hits")).where("hits > 0").orderBy(F.desc("score"), "chunk_id").limit(k).select("chunk_id", "n", "score")


def refined(corpus: Corpus, terms: list[str], words: list[str], k: int = 3, size: int = CHUNK, around: int = 10) -> DataFrame:
    """chunk_id, whole tokens and injected tokens: windows about phrase hits inside a chunk, or all of it without any."""
    best = retrieved(corpus, terms, k, size)
    hits = phrase.positions(corpus, words).select("position", F.floor(F.col("position") / size).alias("chunk_id")).where(F.floor((F.col("position") + len(words) - 1) / size) == F.col("chunk_id"))
    start, end = F.col("chunk_id") * size, F.col("chunk_id") * size + F.col("n") - 1
    spread = hits.join(best, "chunk_id").select("chunk_id", F.explode(F.sequence(F.greatest(F.col("position") - around, start), F.least(F.col("position") + len(words) + around - 1, end))).alias("pos")).distinct()
    kept = spread.groupBy("chunk_id").agg(F.count("*").alias("kept"))
    return best.join(kept, "chunk_id", "left").select("chunk_id", F.col("n").alias("whole_tokens"), F.coalesce("kept", "n").alias("injected_tokens"))


def recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of recall, mean results and queries, for results(query_id, doc_id) against truth(query_id, doc_id)."""
    hit = truth.join(results.distinct(), ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    every = truth.select("query_id").distinct().join(hit, "query_id", "left").join(n, "query_id", "left")
    return every.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), F.avg(F.coalesce("n", F.lit(0)).cast("double")).alias("mean_results"), F.count("*").alias("n_queries"))


def answers(corpus: Corpus, asked: DataFrame) -> DataFrame:
    """query_id, position, doc_id and confidence of a table of questions(query_id, question): each question's search, all in one job.

    A position is a result of a question once, the exact one first.
    """
    near = weighed(corpus, found(corpus, asked), 1.0 - F.col("dist") / 2.0)
    return near.select("query_id", "position", "doc_id", F.when(F.col("dist") == 0, 1.0).otherwise(F.col("confidence") * 0.5).alias("confidence"))


def found(corpus: Corpus, asked: DataFrame) -> DataFrame:
    """query_id, position, doc_id and dist (0: exact) of answers(), without the files' weights.

    A question searches each word of its phrases alone too, so a phrase stands only where its first word is a result. What a position gives thus hangs on its token:
    results are made single by token, and one pass over the tokens finds them, of which none is shuffled.
    """
    exact = asked.select("query_id", F.explode(X.search_words(F.col("question"))).alias("token"), F.lit(0).alias("dist"))
    stop = F.array(*[F.lit(w) for w in X.STOP_WORDS])
    words = asked.select("query_id", F.explode(F.array_distinct(F.filter(X.tokenize(F.col("question")), lambda w: ~F.array_contains(stop, w) & (F.octet_length(w) > 1)))).alias("w"))
    words = words.select("query_id", F.lower("w").alias("query")).distinct()
    close = fuzzy.bulk(corpus, words, 1).join(words, "query").select("query_id", "token", "dist")
    first = exact.unionByName(close).groupBy("query_id", "token").agg(F.min("dist").alias("dist"))
    return corpus.tokens.join(bounded(first), "token").select("query_id", F.col("pos").alias("position"), "doc_id", "dist")


def answered(results: DataFrame, truth: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, n_results, n_exact, n_files and hit (whether a result lies in a file of the truth) for each question, of answers() or found()."""
    exact = F.col("dist") == 0 if "dist" in results.columns else F.col("confidence") == 1.0
    each = results.select("query_id", "doc_id", F.lit(1).alias("n"), exact.cast("int").alias("e"), F.lit(0).alias("t"))
    marks = truth.where("doc_id is not null").select("query_id", "doc_id", F.lit(0).alias("n"), F.lit(0).alias("e"), F.lit(1).alias("t"))  # the truth goes along with the results, and no join sorts them
    seen = each.unionByName(marks).groupBy("query_id", "doc_id").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("t").alias("t")).where("n > 0")
    counts = seen.groupBy("query_id").agg(F.sum("n").alias("n_results"), F.sum("e").alias("n_exact"), F.count("*").alias("n_files"), F.max("t").alias("hit"))
    return asked.select("query_id").join(counts, "query_id", "left").na.fill(0)


def timed(questions: list, run) -> tuple[list, dict]:
    """What run(question) gives for each, and the latency: total, mean and greatest seconds."""
    took, out = [], []
    for q in questions:
        began = time.perf_counter()
        out.append(run(q))
        took.append(time.perf_counter() - began)
    return out, {"total_s": sum(took), "mean_s": sum(took) / max(len(took), 1), "max_s": max(took, default=0.0)}


def compared(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """side (both, first, second) and how many keys."""
    a, b = one.select(key).distinct().withColumn("a", F.lit(1)), two.select(key).distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def totals(refinements: DataFrame) -> DataFrame:
    """One row of refined(): whole and injected tokens of all chunks, and the share that is saved."""
    out = refinements.agg(F.coalesce(F.sum("whole_tokens"), F.lit(0)).alias("whole_tokens"), F.coalesce(F.sum("injected_tokens"), F.lit(0)).alias("injected_tokens"))
    return out.withColumn("saved", F.when(F.col("whole_tokens") > 0, 1 - F.col("injected_tokens") / F.col("whole_tokens")).otherwise(F.lit(0.0)))


def by_folder(corpus: Corpus) -> DataFrame:
    """folder (the first part of the path; empty for files without one), n_files and n_tokens."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    return corpus.files.groupBy(top.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("token_count").alias("n_tokens"))
