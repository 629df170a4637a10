"""The agent tools: a case-folded corpus of its own tokeniser, looser ranking, and reports as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import questions
from ..sources import scratch, store
from . import phrase
from .corpus import Corpus
from .results import enriched, windows

LIMIT = 20


def corpus_of(df: DataFrame, doc_id: str = "doc_id", content: str = "text") -> Corpus:
    return Corpus.from_files(df, doc_id, content, kind="agent")


def phrase_hits(corpus: Corpus, words: list[str]) -> DataFrame:
    """position, doc_id, line_no and confidence (always 1) of a phrase in any case."""
    return phrase.positions(corpus, [w.lower() for w in words]).withColumn("confidence", F.lit(1.0))


def fuzzy_hits(corpus: Corpus, word: str, distance: int = 1) -> DataFrame:
    """token, dist, position (the first of the token), doc_id, line_no and confidence; the word itself is among them."""
    word = word.lower()
    pairs = F.array(*[F.lit(p.encode().hex().upper()) for p in {word[i : i + 2] for i in range(len(word) - 1)}]) if len(word) > 1 else None
    near = corpus.first_places.where(F.abs(F.length("token") - len(word)) <= distance).withColumn("dist", F.levenshtein("token", F.lit(word), distance)).where("dist >= 0")
    near = near.where(F.lit(False)) if pairs is None else near.where(F.arrays_overlap(X.bigrams(F.col("token")), pairs))
    near = near.join(corpus.files.select("doc_id", "token_count"), "doc_id", "left")
    base = 1.0 - F.col("dist") / F.greatest(F.length("token"), F.lit(len(word)))
    return near.select("token", "dist", F.col("pos").alias("position"), "doc_id", "line_no", F.least(F.lit(1.0), base + F.coalesce(X.file_weight(F.col("token_count")), F.lit(0.0))).alias("confidence"))


def search(corpus: Corpus, question: str, limit: int = LIMIT) -> DataFrame:
    """position, doc_id, line_no and confidence: every run of the question's words, then their neighbours; the best for each position, which has one context."""
    words = questions.agent_words(question)
    runs = [words[j : j + n] for n in range(1, len(words) + 1) for j in range(len(words) - n + 1)]
    if not runs:
        return phrase_hits(corpus, [])
    names = F.array(*[F.lit(min(1.0, 0.95 + 0.02 * len(r))) for r in runs])
    exact = phrase.match(corpus, phrase.terms_of(corpus, runs), few=True).withColumn("confidence", F.get(names, F.col("phrase_id")))  # the words of the question
    near = [fuzzy_hits(corpus, w).withColumn("confidence", F.greatest("confidence", F.lit(0.5))) for w in dict.fromkeys(words)]
    every = reduce(DataFrame.unionByName, [x.select("position", "doc_id", "line_no", "confidence") for x in [exact, *near]])
    best = every.groupBy("position").agg(F.max("confidence").alias("confidence"), F.max(F.struct("doc_id", "line_no")).alias("f"))
    return best.select("position", "f.doc_id", "f.line_no", "confidence").orderBy(F.desc("confidence"), "position").limit(limit)


def context(corpus: Corpus, hits: DataFrame, window: int = 50) -> DataFrame:
    """The hits with so many tokens on either side, and dots where the text goes on."""
    total = corpus.tokens.agg(F.count("*").alias("__n"))
    out = windows(corpus, hits, window, window, "__w").crossJoin(F.broadcast(total))  # one row
    return out.withColumn("context", F.concat(F.when(F.col("position") > window, F.lit("... ")).otherwise(""), "__w", F.when(F.col("position") + window < F.col("__n"), F.lit(" ...")).otherwise(""))).drop("__w", "__n")


def report(corpus: Corpus, hits: DataFrame, needles: list[str], per_file: int | None = 5) -> DataFrame:
    """doc_id, n and text: hits(position, doc_id, line_no, confidence) by file, the first few of each."""
    rows = enriched(corpus, hits.select("position", "doc_id", "line_no", F.col("confidence").alias("__c")), F.lit(0.0), F.lit(""), [F.lit(w) for w in needles], ("doc_id", "__c"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("__c"), "position")
    line = F.format_string("  [POS %d] conf=%.2f | line %d: %s", "position", "__c", "line_number", "highlighted_snippet")
    ranked = rows.withColumn("__r", F.row_number().over(order)).withColumn("__line", line)
    shown = F.when(F.col("__r") <= per_file, F.struct("__r", "__line")) if per_file else F.struct("__r", "__line")
    by = ranked.groupBy("doc_id", "file_path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(shown)).alias("s"))
    more = F.when(F.col("n") > per_file, F.array(F.format_string("  ... and %d more matches", F.col("n") - per_file))).otherwise(F.array().cast("array<string>")) if per_file else F.array().cast("array<string>")
    head = F.array(F.format_string("=== %s (%d matches) ===", "file_path", "n"))
    return by.select("doc_id", "n", F.array_join(F.concat(head, F.transform("s", lambda r: r["__line"]), more), "\n").alias("text"))


class Tools:
    """The eight tools, each giving text; files and texts become segments of a stored corpus, and adding one reads none of the others."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.built = spark, path or scratch.folder(spark), None

    def index_text(self, text: str) -> str:
        return self.index_file("(text)", text)

    def index_file(self, path: str, content: str) -> str:
        self.index_files(self.spark.createDataFrame([(path, content)], "path string, text string"))
        return f"Indexed {len(questions.agent_tokens(content))} tokens from {path}."

    def index_files(self, files: DataFrame) -> None:
        """Add files(path, text) as one segment."""
        store.append(self.spark, self.path, files, kind="agent")
        self._drop()

    def _corpus(self) -> Corpus:
        if self.built is None:  # once for all questions until a file comes
            self.built = store.load(self.spark, self.path) if store.manifest(self.spark, self.path) else store.empty(self.spark, "agent")
            self.built = self.built.persisted()
        return self.built

    def _drop(self) -> None:
        if self.built is not None:
            self.built.files.unpersist()
            self.built.tokens.unpersist()
        self.built = None

    def _text(self, hits: DataFrame, needles: list[str], none: str, per_file: int | None = None) -> str:
        found = report(self._corpus(), hits, needles, per_file).orderBy("doc_id").collect()
        return "\n\n".join(r["text"] for r in found) or none

    def phrase_search(self, text: str) -> str:
        words = questions.agent_tokens(text)
        return self._text(phrase_hits(self._corpus(), words), words, "No matches found.")

    def fuzzy_search(self, word: str, max_distance: int = 1) -> str:
        return self._text(fuzzy_hits(self._corpus(), word, max_distance), [word.lower()], "No fuzzy matches found.")

    def search(self, question: str) -> str:
        return self._text(search(self._corpus(), question), questions.agent_words(question), "No matches found.", 5)

    def get_stats(self) -> str:
        c = self._corpus()
        s, files = c.stats().first(), c.file_stats().orderBy("doc_id").collect()
        return "\n".join([f"Total positions: {s['total_tokens']}", f"Unique tokens: {s['unique_tokens']}", f"Memory: {s['memory_bytes'] / 1024:.2f} KB", f"Files indexed: {s['n_files']}", *[f"  - {f['path']}: {f['token_count']} tokens" for f in files]])

    def get_file_content(self, path: str) -> str:
        row = self._corpus().content(path).first()
        return "File not found." if row is None else row["content"]

    def clear_index(self) -> str:
        store.delete(self.spark, self.path)
        self._drop()
        return "Index cleared."
