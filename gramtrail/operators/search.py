"""Questions in plain words: exact phrases first, neighbours of the words next, one result for each position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import questions
from . import fuzzy, phrase
from .corpus import Corpus, bounded, in_order, settled
from .results import COLUMNS, enriched


def _hits(corpus: Corpus, question: str) -> DataFrame | None:
    """position, doc_id, line_no, __rank, __context, __base (null for exact phrases), __one and __two: what was found where, and what is shown in bold."""
    phrases, parts = questions.parse(question), []
    nothing = F.lit(None)
    if phrases:
        texts = F.array(*[F.lit(" ".join(p)) for p in phrases])
        name = F.get(texts, F.col("phrase_id"))
        exact = phrase.match(corpus, phrase.terms_of(corpus, phrases), few=True)  # the words of the question
        parts.append(exact.select("position", "doc_id", "line_no", F.col("phrase_id").alias("__rank"), F.format_string("[POS %d] matched: '%s'", "position", name).alias("__context"), nothing.cast("double").alias("__base"), F.element_at(F.split(name, " "), 1).alias("__one"), nothing.cast("string").alias("__two")))
    words = [w.lower() for w in dict.fromkeys(questions.fuzzy_words(question))]
    if words:
        close = [fuzzy.candidates(corpus, w, 1).select("token", "dist", F.lit(w).alias("word"), F.lit(len(phrases) + i).alias("__rank")) for i, w in enumerate(words)]
        near = corpus.tokens.join(bounded(reduce(DataFrame.unionByName, close)), "token").withColumnRenamed("pos", "position")
        parts.append(near.select("position", "doc_id", "line_no", "__rank", F.format_string("[POS %d] fuzzy: '%s' (dist=%d) -> '%s'", "position", "token", "dist", "word").alias("__context"), (1.0 - F.col("dist") / 2.0).alias("__base"), F.col("token").alias("__one"), F.col("word").alias("__two")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def search(corpus: Corpus, question: str) -> DataFrame:
    """Result rows ranked by confidence and position."""
    every = _hits(corpus, question)
    if every is None:
        return enriched(corpus, phrase.positions(corpus, []), F.lit(1.0), F.lit(""), [])
    rest = [c for c in every.columns if c not in ("position", "__rank")]
    first = every.groupBy("position").agg(F.min_by(F.struct(*rest), "__rank").alias("r")).select("position", "r.*")  # one result a position
    found, few = settled(first)
    rows = enriched(corpus, found, F.coalesce("__base", F.lit(1.0)), F.col("__context"), [F.col("__one"), F.col("__two")], ("__base",), few)
    rows = rows.withColumn("confidence", F.when(F.col("__base").isNull(), 1.0).otherwise(F.col("confidence") * 0.5)).select(*COLUMNS)
    return in_order(rows, few, F.desc("confidence"), "position")
