"""A corpus as tables: files with their token ranges, one row for each token occurrence, and the lexicon."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Documents of one run of the prefix sum; the second level has a row for each run.
RUN = 1 << 16
#: Rows of hits or query terms that may be broadcast.
BROADCAST_ROWS = 100_000


def prefix_sums(rows: DataFrame, order: str, value: str, out: str, unique: bool = False) -> DataFrame:
    """The sum of value over all rows of smaller order, in two levels: within runs of ids, then over runs. unique: an order given twice is an error."""
    run = rows.withColumn("__run", F.floor(F.col(order) / RUN))
    inside = Window.partitionBy("__run").orderBy(order)
    before = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if unique:
        twice = F.raise_error(F.concat(F.lit(f"{order} given twice: "), F.col(order).cast("string"))).cast("long")
        before = F.when(F.lag(order).over(inside) == F.col(order), twice).otherwise(before)
    totals = run.groupBy("__run").agg(F.sum(value).alias("__n"))  # a row for each 65,536 documents
    starts = totals.select("__run", F.coalesce(F.sum("__n").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return run.withColumn("__in", before).join(starts, "__run").withColumn(out, (F.col("__start") + F.col("__in")).cast("long")).drop("__run", "__in", "__start")


def settled(rows: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The rows, and whether they are few: few rows are made once, and every join to them is a broadcast; others stay a plan for Spark to join."""
    few = rows.limit(most + 1).toArrow()
    if few.num_rows > most:
        return rows, False
    return F.broadcast(rows.sparkSession.createDataFrame(few, rows.schema)), True


def bounded(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, for a broadcast where they are few."""
    return settled(rows, most)[0]


def in_order(rows: DataFrame, few: bool, *keys) -> DataFrame:
    """The rows in a global order; few ones need no sampled ranges."""
    return rows.coalesce(1).sortWithinPartitions(*keys) if few else rows.orderBy(*keys)


def local_tokens(base: DataFrame, kind: str, *keep: str) -> DataFrame:
    """token, doc_id, local_pos, line_no and next (null for the last) of base(doc_id, content), in one narrow pass."""
    rows = base.select("doc_id", *keep, X.tokens_with_lines(F.col("content"), kind).alias("w"))
    follow = F.slice(F.col("w.token"), F.lit(2), F.size("w"))
    each = rows.select("doc_id", *keep, F.posexplode(F.arrays_zip(F.col("w.token").alias("token"), F.col("w.line_no").alias("line_no"), follow.alias("next"))).alias("local_pos", "t"))
    return each.select(F.col("t.token").alias("token"), "doc_id", "local_pos", F.col("t.line_no").alias("line_no"), F.col("t.next").alias("next"), *keep)


def counted(base: DataFrame, kind: str, *keep: str) -> DataFrame:
    """doc_id, token_count and the first token of base(doc_id, content)."""
    return base.select("doc_id", *keep, X.tokenize(F.col("content"), kind).alias("w")).select("doc_id", *keep, F.size("w").cast("long").alias("token_count"), F.get("w", 0).alias("first"))


def ranges_of(counts: DataFrame) -> DataFrame:
    """counts(doc_id, token_count, first, ...) with token_start, token_end and after, the first token of the next file that has any."""
    ranges = prefix_sums(counts, "doc_id", "token_count", "token_start", unique=True).withColumn("token_end", F.col("token_start") + F.col("token_count"))
    # The file after one begins where it ends; files without tokens are passed over.
    after = ranges.where("token_count > 0").select(F.col("token_start").alias("token_end"), F.col("first").alias("after"))
    return ranges.join(after, "token_end", "left")


def placed(local: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """Token rows with positions: local ones joined to the start of their file."""
    return positioned(local.join(ranges.select(*on, "token_start", "token_count", "after"), on))


def positioned(both: DataFrame, *keep: str) -> DataFrame:
    """Token rows with positions, of local ones with the start of their file; the last token of a file is followed by the first of the next."""
    follow = F.when(F.col("local_pos") + 1 == F.col("token_count"), F.col("after")).otherwise(F.col("next"))
    return both.select("token", (F.col("token_start") + F.col("local_pos")).alias("pos"), "doc_id", "local_pos", "line_no", follow.alias("next"), *keep)


def with_next(tokens: DataFrame) -> DataFrame:
    """tokens with the token at pos + 1: within runs of positions, then over their borders."""
    inside = Window.partitionBy(F.floor(F.col("pos") / RUN)).orderBy("pos")  # 65,536 positions
    near = F.when(F.lead("pos").over(inside) == F.col("pos") + 1, F.lead("token").over(inside))
    border = tokens.where(F.col("pos") % RUN == 0).select((F.col("pos") - 1).alias("pos"), F.col("token").alias("__over"))
    return tokens.withColumn("next", near).join(border, "pos", "left").withColumn("next", F.coalesce("next", "__over")).drop("__over")


@dataclass(frozen=True)
class Corpus:
    """files(doc_id, path, content, token_start, token_end, token_count, first) and tokens(token, pos, doc_id, local_pos, line_no, and next, the token at pos + 1, where it is known)."""

    files: DataFrame
    tokens: DataFrame
    kind: str = "core"
    kept: bool = False
    #: Whether every token lies in a file and comes from its content, so that tokens at given places can be made from the files that hold them.
    filed: bool = False
    #: The files with after, from which the tokens are made without a join; None where tokens are read or joined.
    base: DataFrame | None = None

    @classmethod
    def from_files(cls, df: DataFrame, doc_id: str = "doc_id", content: str = "text", path: str | None = None, kind: str = "core") -> "Corpus":
        """Files in the order of doc_id, a number; positions run through all of them. Files without an id take no part; an id given twice is an error when positions are made."""
        p = F.col(path) if path else F.col(doc_id).cast("string")
        base = df.select(F.col(doc_id).cast("long").alias("doc_id"), p.alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content")).where("doc_id is not null")
        return cls._over(base.join(ranges_of(counted(base, kind)), "doc_id", "left"), kind)  # outer: every file has its range, and no text is broadcast

    @classmethod
    def _over(cls, base: DataFrame, kind: str, kept: bool = False) -> "Corpus":
        """A corpus of files that know where they start: a text meets its range once, before it is cut into tokens, which are several times larger."""
        return cls(base.select(*FILES.fieldNames()), positioned(local_tokens(base, kind, "token_start", "token_count", "after")), kind, kept, True, base)

    @classmethod
    def from_tokens(cls, df: DataFrame, token: str = "token", pos: str = "pos") -> "Corpus":
        """A bare token stream: no file holds its positions."""
        spark = df.sparkSession
        tokens = df.select(F.col(token).alias("token"), F.col(pos).cast("long").alias("pos"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("local_pos"), F.lit(None).cast("int").alias("line_no"))
        return cls(spark.createDataFrame([], FILES), tokens)

    @property
    def texts(self) -> DataFrame | None:
        """The files with after, where all tokens can be made from them."""
        return self.base

    def all_tokens(self, *keep: str) -> DataFrame:
        """All tokens with next and some columns of their files: cut from the texts where these are known, so that these are shuffled and not the tokens."""
        if self.texts is None:
            return self.paired.join(self.files.select("doc_id", *keep), "doc_id", "left") if keep else self.paired
        return positioned(local_tokens(self.texts, self.kind, "token_start", "token_count", "after", *keep), *keep)

    @property
    def spark(self) -> SparkSession:
        return self.tokens.sparkSession

    def persisted(self) -> "Corpus":
        """The same corpus with its tables kept by Spark, on disk where memory ends; lost blocks are computed again."""
        level = StorageLevel.MEMORY_AND_DISK
        if self.base is not None:
            own = Corpus._over(self.base.persist(level), self.kind, True)
            return replace(own, tokens=own.tokens.persist(level))
        return replace(self, files=self.files.persist(level), tokens=self.tokens.persist(level), kept=True)

    def _keep(self, rows: DataFrame) -> DataFrame:
        return rows.persist(StorageLevel.MEMORY_AND_DISK) if self.kept else rows

    @cached_property
    def lines(self) -> DataFrame:
        """doc_id, line_no from 1 and line."""
        each = self.files.select("doc_id", F.posexplode(X.lines(F.col("content"))).alias("i", "line"))
        return self._keep(each.select("doc_id", (F.col("i") + 1).alias("line_no"), "line"))

    @cached_property
    def first_places(self) -> DataFrame:
        """token and its first occurrence: pos, doc_id and line_no."""
        first = self.tokens.groupBy("token").agg(F.min("pos").alias("first"), F.min_by("doc_id", "pos").alias("doc_id"), F.min_by("line_no", "pos").alias("line_no"))
        return self._keep(first.withColumnRenamed("first", "pos"))

    @property
    def sequence(self) -> DataFrame:
        """pos and token, for lookups by position."""
        return self.tokens.select("pos", "token")

    @property
    def paired(self) -> DataFrame:
        """The tokens with the token after each; null at the end of the stream."""
        return self.tokens if "next" in self.tokens.columns else with_next(self.tokens)

    @cached_property
    def lexicon(self) -> DataFrame:
        """token, freq and n_docs."""
        return self._keep(self._lexicon())

    def _lexicon(self) -> DataFrame:
        return self.tokens.groupBy("token", "doc_id").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("freq"), F.count("*").alias("n_docs"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """The words of the lexicon alone (token): no counts by file are shuffled for them."""
        return self.lexicon.select("token") if "lexicon" in self.__dict__ else self._keep(self._vocabulary())

    def _vocabulary(self) -> DataFrame:
        return self.tokens.select("token").distinct()

    @property
    def pairs(self) -> DataFrame | None:
        """pair and token: the lexicon by pairs of bytes, clustered by them, where a stored corpus has it; pair_counts then says how many words have a pair."""
        return None

    pair_counts = pairs

    def postings(self) -> DataFrame:
        """token and its positions by file, so that no array outgrows a file."""
        return self.tokens.groupBy("token", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))

    def stats(self) -> DataFrame:
        """One row: total_tokens, unique_tokens, n_files, postings_bytes (bitmaps of positions) and memory_bytes (these, lexicon and sequence)."""
        from .bitmaps import sizes

        lex = self.lexicon.agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("total_tokens"), F.count("*").alias("unique_tokens"), F.coalesce(F.sum(F.octet_length("token") + 24), F.lit(0)).cast("long").alias("__b"))
        files = self.files.agg(F.count("*").alias("n_files"))
        maps = sizes(self).agg(F.coalesce(F.sum(F.col("bytes") + 28), F.lit(0)).cast("long").alias("postings_bytes"))  # 28 for the entry of each
        every = lex.crossJoin(files).crossJoin(maps)  # single rows
        return every.select("total_tokens", "unique_tokens", "n_files", "postings_bytes", (F.col("__b") + 4 * F.col("total_tokens") + F.col("postings_bytes")).alias("memory_bytes"))

    def file_stats(self) -> DataFrame:
        return self.files.select("doc_id", "path", "token_start", "token_end", "token_count")

    def top_tokens(self, n: int = 20) -> DataFrame:
        return self.lexicon.select("token", "freq").orderBy(F.desc("freq"), "token").limit(n)

    def line(self, doc_id: Column, line_no: Column) -> DataFrame:
        return self.files.where(F.col("doc_id") == doc_id).select(X.line_at(F.col("content"), line_no).alias("line_content"))

    def content(self, path: str) -> DataFrame:
        """The content of a file."""
        return self.files.where(F.col("path") == path).select("path", "content", "token_count")

    def at(self, positions: DataFrame) -> DataFrame:
        """Token, file and line at each position; null outside the corpus."""
        return positions.join(self.tokens.select("pos", "token", "doc_id", "line_no"), "pos", "left")

    def overlapping(self, start: int, end: int) -> DataFrame:
        """Files whose token range meets [start, end)."""
        return self.files.where((F.col("token_start") < end) & (F.col("token_end") > start)).select("doc_id", "path", "token_start", "token_end")

    def near(self, hits: DataFrame, before: int, after: int, key: str = "position", few: bool = False) -> DataFrame:
        """Tokens at [position - before, position + after) of each hit: position, pos and token."""
        around = hits.select(key).distinct().select(key, F.explode(F.sequence(F.greatest(F.col(key) - before, F.lit(0)), F.col(key) + after - 1)).alias("pos"))
        if not few:
            around, few = settled(around)
        return self.looked_up(around, few)

    def looked_up(self, around: DataFrame, few: bool) -> DataFrame:
        """The rows around(pos, ...) with the token at pos, where there is one.

        Few rows are broadcast to the tokens. Many meet the files that hold them, which are cut into tokens once more, so that the tokens are not shuffled.
        """
        if few:
            return F.broadcast(around).join(self.sequence_at(around), "pos")
        return around.join(self._made(around.select("pos").distinct()) if self.filed else self.sequence, "pos")

    def _made(self, asked: DataFrame) -> DataFrame:
        """pos and token at each pos of asked, made from the contents of the files there."""
        files = self.files.where("token_count > 0").select("doc_id", "token_start", "token_end")
        runs = files.withColumn("__run", F.explode(F.sequence(F.floor(F.col("token_start") / RUN), F.floor((F.col("token_end") - 1) / RUN))))
        held = runs.join(asked.withColumn("__run", F.floor(F.col("pos") / RUN)), "__run").where("pos >= token_start AND pos < token_end")
        own = held.groupBy("doc_id").agg(F.collect_list((F.col("pos") - F.col("token_start")).cast("int")).alias("__at"))  # places within a file
        words = self.files.select("doc_id", "token_start", "content").join(own, "doc_id").select("token_start", "__at", X.tokenize(F.col("content"), self.kind).alias("__w"))
        return words.select("token_start", "__w", F.explode("__at").alias("__i")).select((F.col("token_start") + F.col("__i")).alias("pos"), F.expr("__w[__i]").alias("token"))

    def sequence_at(self, around: DataFrame) -> DataFrame:
        """The rows of sequence, of which only those at the positions of around are wanted."""
        return self.sequence

    def lines_at(self, asked: DataFrame, few: bool) -> DataFrame:
        """doc_id, line_no and line of asked(doc_id, line_no): only the files that hold them are cut into lines."""
        own = asked.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("line_no").alias("__no"))  # lines of a file
        rows = self.contents_of(own, few).select("doc_id", "__no", X.lines(F.col("content")).alias("__l"))
        return rows.select("doc_id", "__l", F.explode("__no").alias("line_no")).select("doc_id", "line_no", F.get("__l", F.col("line_no") - 1).alias("line"))

    def contents_of(self, own: DataFrame, few: bool) -> DataFrame:
        """own(doc_id, ...) with the contents of these files; few ones are broadcast."""
        return self.files.select("doc_id", "content").join(F.broadcast(own) if few else own, "doc_id")

    # The search operators are functions of their own; these are short ways to them.
    def phrase(self, words: list[str], **options) -> DataFrame:
        from .phrase import search

        return search(self, words, **options)

    def phrases(self, terms: DataFrame, **options) -> DataFrame:
        from .phrase import match

        return match(self, terms, **options)

    def fuzzy(self, word: str, distance: int = 1, **options) -> DataFrame:
        from .fuzzy import search

        return search(self, word, distance, **options)

    def fuzzy_join(self, queries: DataFrame, distance: int = 1) -> DataFrame:
        from .fuzzy import bulk

        return bulk(self, queries, distance)

    def search(self, question: str) -> DataFrame:
        from .search import search

        return search(self, question)

    def bm25(self, words: list[str], k: int = 10, variant: str = "reference") -> DataFrame:
        from .bm25 import search

        return search(self, words, k, variant)

    def hybrid(self, question: str, k: int = 10, mode: str = "documented") -> DataFrame:
        from .hybrid import search

        return search(self, question, k, mode)

    def update(self, changed: DataFrame, **columns) -> "Corpus":
        from .incremental import update

        return update(self, changed, **columns)

    def save(self, path: str) -> bool:
        from ..sources.store import save

        return save(self, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Corpus":
        from ..sources.store import load

        return load(spark, path)


FILES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("token_start", T.LongType()), T.StructField("token_end", T.LongType()), T.StructField("token_count", T.LongType()), T.StructField("first", T.StringType())])
TOKEN_ROWS = T.StructType([T.StructField("token", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("local_pos", T.IntegerType()), T.StructField("line_no", T.IntegerType())])
