"""Search with typos over the lexicon, then over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import Corpus, bounded, in_order, settled
from .results import enriched


def _close(token: Column, word: Column, distance: int) -> Column:
    """Byte lengths at most so far apart, and a distance of 1 to so many."""
    return (F.abs(F.octet_length(token) - F.octet_length(word)) <= distance) & F.levenshtein(token, word, distance).between(1, distance)


def asked_pairs(corpus: Corpus, word: str, distance: int) -> list[str]:
    """The pairs of bytes that a word's neighbours are looked up by: the rarest that cover more places than so many edits can touch, else all.

    An edit touches at most one place more than its character has bytes, so that some place of the rarest pairs is left in every neighbour.
    """
    b = word.encode()
    places = [b[i : i + 2].hex().upper() for i in range(len(b) - 1)]
    need = distance * (max(len(c.encode()) for c in word) + 1) + 1
    if len(places) < need:
        return sorted(set(places))
    known = {r["pair"]: r["n"] for r in corpus.pair_counts.where(F.col("pair").isin(places)).collect()}  # at most a row for each pair of the word
    out, covered = [], 0
    for pair in sorted(set(places), key=lambda p: (known.get(p, 0), p)):
        out.append(pair)
        covered += places.count(pair)
        if covered >= need:
            break
    return out


def candidates(corpus: Corpus, word: str, distance: int, prefilter: bool = True) -> DataFrame:
    """token and dist of the lexicon's neighbours of a word; with the prefilter they share a pair of bytes with it.

    Where the lexicon is kept by pairs, only the words that have one of a few rare pairs are read.
    """
    b = word.encode()
    by_pair = prefilter and len(b) >= 2
    if by_pair and corpus.pairs is not None:
        lex = corpus.pairs.where(F.col("pair").isin(asked_pairs(corpus, word, distance))).where(_close(F.col("token"), F.lit(word), distance)).select("token").distinct()
        return lex.select("token", F.levenshtein("token", F.lit(word)).alias("dist"))
    lex = corpus.vocabulary.where(_close(F.col("token"), F.lit(word), distance))  # the cheap test first
    if by_pair:
        pairs = F.array(*[F.lit(b[i : i + 2].hex().upper()) for i in range(len(b) - 1)])
        lex = lex.where(F.arrays_overlap(X.bigrams(F.col("token")), pairs))
    return lex.select("token", F.levenshtein("token", F.lit(word)).alias("dist"))


def hits(corpus: Corpus, word: str, distance: int = 1, prefilter: bool = True) -> DataFrame:
    """position, doc_id, line_no, token and dist of every position of every neighbour."""
    close = candidates(corpus, word, distance, prefilter)
    return corpus.tokens.join(bounded(close), "token").select(F.col("pos").alias("position"), "doc_id", "line_no", "token", "dist")


def search(corpus: Corpus, word: str, distance: int = 1, prefilter: bool = True) -> DataFrame:
    """Result rows of every position of every neighbour, with token and dist, the most confident first."""
    found, few = settled(hits(corpus, word, distance, prefilter))
    context = F.format_string("[POS %d] fuzzy: '%s' (dist=%d) -> '%s'", "position", "token", "dist", F.lit(word))
    base = F.lit(1.0) - F.col("dist") / (distance + 1.0)
    return in_order(enriched(corpus, found, base, context, [F.col("token"), F.lit(word)], ("token", "dist"), few), few, F.desc("confidence"), "position")


def _by_pair(rows: DataFrame, word: str) -> DataFrame:
    """The rows for each pair of neighbouring bytes of a word: pairs are cut after the rows are made, as arrays of them cost more than the join."""
    each = rows.where(F.octet_length(word) >= 2).withColumn("__i", F.explode(F.sequence(F.lit(1), F.octet_length(word) - 1)))
    return each.withColumn("pair", F.substring(F.encode(word, "utf-8"), F.col("__i"), F.lit(2))).drop("__i")


def bulk(corpus: Corpus, queries: DataFrame, distance: int = 1) -> DataFrame:
    """query, token and dist for a table of words (query): an equi-join on pairs of bytes and the length in bytes, then the distance."""
    left, n = _by_pair(queries.select("query").distinct(), "query").distinct(), F.octet_length("query")
    left = bounded(left.withColumn("bytes", F.explode(F.sequence(n - distance, n + distance))))
    right = _by_pair(corpus.vocabulary.select("token", F.octet_length("token").alias("bytes")), "token")
    near = right.join(left, ["pair", "bytes"]).select("query", "token", F.levenshtein("query", "token", distance).alias("dist"))
    return near.where(F.col("dist").between(1, distance)).distinct()  # the neighbours alone are shuffled
