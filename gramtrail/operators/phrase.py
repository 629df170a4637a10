"""Exact phrase search, one or many phrases in a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus, in_order, settled
from .results import enriched, windows


def terms_of(corpus: Corpus, phrases: list[list[str]]) -> DataFrame:
    """phrase_id, off, token and k of literal phrases."""
    rows = [(i, off, w, len(p)) for i, p in enumerate(phrases) for off, w in enumerate(p)]
    return corpus.spark.createDataFrame(rows, "phrase_id int, off int, token string, k int")


def match(corpus: Corpus, terms: DataFrame, within_file: bool = False, few: bool = False) -> DataFrame:
    """phrase_id, position, doc_id and line_no of each occurrence of phrases given as terms(phrase_id, off, token, k).

    Phrases of the same words are searched once. A phrase is covered by pairs of neighbouring words, and an equi-join on both words of
    a pair finds the places of the pair alone, not those of each word; a phrase of three or more words
    stands where all of its pairs do. few says that the terms are the words of a query, so that no count need find out.
    """
    if not few:
        terms, few = settled(terms)
    lengths = {r["k"] for r in terms.select(F.least("k", F.lit(3)).alias("k")).distinct().collect()} if few else {1, 2, 3}  # three rows; each length that is asked is one pass over the tokens
    bound = F.broadcast if few else lambda rows: rows
    phrases = terms.groupBy("phrase_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("off", "token"))), lambda t: t["token"]).alias("words"), F.max("k").alias("k")).where("size(words) = k")  # the words of a phrase
    texts = phrases.groupBy("words").agg(F.min("phrase_id").alias("text_id"))
    k = F.size("words")
    one = texts.where(k == 1).select("text_id", F.get("words", 0).alias("token"))
    two = texts.where(k > 1).select("text_id", "words", k.alias("k"), F.explode(F.array_union(F.sequence(F.lit(0), k - 2, F.lit(2)), F.array(k - 2))).alias("off"))
    two = two.select("text_id", "k", "off", F.expr("words[off]").alias("token"), F.expr("words[off + 1]").alias("next"))
    at = ["text_id", "position", "doc_id", "line_no"]
    single = corpus.tokens.join(bound(one), "token").withColumn("position", F.col("pos")).select(*at, F.lit(1).alias("k"))
    pairs = corpus.paired.join(bound(two), ["token", "next"]).withColumn("position", F.col("pos") - F.col("off"))
    whole = pairs.where("k = 2").select(*at, "k")
    keys = ["text_id", "position", *(["doc_id"] if within_file else [])]
    longer = pairs.where("k > 2").groupBy(*keys).agg(F.count("*").alias("n"), F.max("k").alias("k"), *[F.max(F.when(F.col("off") == 0, F.col(c))).alias(f"__{c}") for c in ("doc_id", "line_no")]).where("n = (k + 1) div 2")
    longer = longer.select("text_id", "position", F.col("__doc_id").alias("doc_id"), F.col("__line_no").alias("line_no"), "k")
    found = reduce(DataFrame.unionByName, [rows for n, rows in ((1, single), (2, whole), (3, longer)) if n in lengths] or [single])
    if within_file:
        found = found.join(corpus.files.select("doc_id", "token_end"), "doc_id").where("position + k <= token_end")
    return found.join(bound(phrases.join(texts, "words").select("text_id", "phrase_id")), "text_id").select("phrase_id", "position", "doc_id", "line_no")


def positions(corpus: Corpus, words: list[str], within_file: bool = False) -> DataFrame:
    """position, doc_id and line_no of a literal phrase."""
    if not words:
        return corpus.tokens.select(F.col("pos").alias("position"), "doc_id", "line_no").limit(0)
    if len(words) == 1:
        return corpus.tokens.where(F.col("token") == words[0]).select(F.col("pos").alias("position"), "doc_id", "line_no")
    pairs = corpus.paired
    at = lambda k: pairs.where((F.col("token") == words[k]) & (F.col("next") == words[k + 1]))
    found = at(0).select(F.col("pos").alias("position"), "doc_id", "line_no")
    for k in sorted({*range(2, len(words) - 1, 2), len(words) - 2} - {0}):  # pairs cover the words
        found = found.join(at(k).select((F.col("pos") - k).alias("position")), "position", "left_semi")
    if within_file:
        found = found.join(corpus.files.select("doc_id", "token_end"), "doc_id").where(F.col("position") + len(words) <= F.col("token_end")).drop("token_end")
    return found.select("position", "doc_id", "line_no")


def search(corpus: Corpus, words: list[str], within_file: bool = False) -> DataFrame:
    """Result rows of a phrase by position; three tokens of context before it."""
    text = " ".join(words)
    hits, few = settled(positions(corpus, words, within_file))
    hits = windows(corpus, hits, 3, max(len(words), 1), "__around", few)
    context = F.when(F.col("__around").contains(" "), F.format_string("[POS %d] '%s' (context: ... %s)", F.col("position"), F.lit(text), F.col("__around"))).otherwise(F.format_string("[POS %d] matched: '%s'", F.col("position"), F.lit(text)))
    return in_order(enriched(corpus, hits, F.lit(1.0), context, [F.lit(w) for w in words], few=few), few, "position")


def intersected(corpus: Corpus, words: list[str]) -> DataFrame:
    """The same positions as an intersection of shifted position sets."""
    out = None
    for off, w in enumerate(words):
        own = corpus.tokens.where(F.col("token") == w).select((F.col("pos") - off).alias("position"))
        out = own if out is None else out.intersect(own)
    return out


def adjacent_repeats(corpus: Corpus, segment: int | None = None) -> DataFrame:
    """position and token where a token is followed by itself, within one segment of the stream if given."""
    out = corpus.paired.where("token = next").select(F.col("pos").alias("position"), "token")
    return out if segment is None else out.where(F.floor(F.col("position") / segment) == F.floor((F.col("position") + 1) / segment))
