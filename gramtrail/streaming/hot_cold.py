"""An append-only token stream: micro-batches become whole segments, and queries see these and the rest.

A segment holds a fixed count of positions, [s * size, (s + 1) * size), so that segments do not depend on how the stream was cut into batches. A batch is
laid after what was left of the one before: its whole segments are cold, written once with the token after each token inside the segment, and the
rest, less than a segment, is hot until a later batch fills it up. A row for each segment has its first and last token, so that pairs over borders need no window
over the stream. Each batch is written under its own number; a batch that runs again overwrites itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import phrase
from ..operators.corpus import FILES, TOKEN_ROWS, Corpus, in_order, prefix_sums, settled

ROWS = T.StructType([T.StructField("token", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("next", T.StringType())])
SEGMENTS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("segment", "start_pos", "token_count", "bytes")], T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])


def json_bytes(token: Column) -> Column:
    """What a token adds to a JSON list of tokens."""
    return F.octet_length(F.to_json(F.array(token))) - 1


@dataclass(frozen=True)
class TokenStream:
    """A stream kept in a folder; size is the count of positions of a segment."""

    spark: SparkSession
    path: str
    size: int = 10_000

    def _there(self, name: str) -> bool:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*schema.fieldNames())  # not the number of the batch

    def _last(self, before: int | None = None) -> tuple[int, int | None]:
        """The position after the batches (before one), and the number of the last: a row for each is kept, so that no batch reads the tokens again."""
        if not self._there("ends"):
            return 0, None
        ends = self.spark.read.schema("position long, batch long").option("basePath", f"{self.path}/ends").parquet(f"{self.path}/ends")
        row = (ends if before is None else ends.where(F.col("batch") < before)).agg(F.max(F.struct("batch", "position")).alias("e")).first()["e"]
        return (0, None) if row is None else (row["position"], row["batch"])

    def append(self, tokens: DataFrame, batch: int, order: list[str] | None = None) -> None:
        """Write tokens(token and the order columns, numbers) as one batch, after the positions of the batches before it."""
        start, last = self._last(batch)
        keys = order or ["ord"]
        # Positions from counts by the first order column, summed in two levels, so that no task numbers the whole batch.
        starts = prefix_sums(tokens.groupBy(keys[0]).agg(F.count("*").alias("n")), keys[0], "n", "s").select(keys[0], "s")
        inside = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys)) - 1
        rows = tokens.withColumn("i", inside).join(starts, keys[0]).select("token", (F.lit(start) + F.col("s") + F.col("i")).cast("long").alias("pos"))
        if last is not None:  # less than a segment
            rows = rows.unionByName(self._read(f"hot/batch={last}", ROWS).select("token", "pos"))
        segment = Window.partitionBy("segment").orderBy("pos")
        rows = rows.withColumn("segment", self.segment(F.col("pos"))).withColumn("next", F.lead("token").over(segment))
        at = f"{self.path}/new/batch={batch}"
        rows.repartitionByRange("segment").sortWithinPartitions("segment", "pos").write.mode("overwrite").parquet(at)
        rows = self.spark.read.schema("token string, pos long, segment long, next string").parquet(at)
        kinds = rows.groupBy("segment").agg(
            F.min("pos").alias("start_pos"), F.count("*").alias("token_count"), (F.sum(json_bytes(F.col("token"))) + 1).alias("bytes"), F.min_by("token", "pos").alias("first"), F.max_by("token", "pos").alias("last")
        )
        kinds.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch}")
        counts = self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/counts/batch={batch}")
        end = counts.agg(F.max(F.col("start_pos") + F.col("token_count"))).first()[0]
        end = start if end is None else end
        whole = F.col("segment") < end // self.size
        rows.where(whole).drop("segment").write.mode("overwrite").parquet(f"{self.path}/cold/batch={batch}")
        counts.where(whole).write.mode("overwrite").parquet(f"{self.path}/segments/batch={batch}")
        rows.where(~whole).drop("segment").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/hot/batch={batch}")
        self.spark.createDataFrame([(end,)], "position long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ends/batch={batch}")
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/new")
        fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(fs, True)

    def start(self, stream: DataFrame, order: list[str], checkpoint: str):
        """Run a stream of tokens into the folder until its source is read; returns when done."""
        query = stream.writeStream.foreachBatch(lambda df, n: self.append(df, n, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def _hot(self) -> DataFrame:
        last = self._last()[1]
        return self.spark.createDataFrame([], ROWS) if last is None else self._read(f"hot/batch={last}", ROWS)

    def rows(self) -> DataFrame:
        """token, pos and next of all layers; the last token of a segment comes from the segment's row, with the first of the next one."""
        hot, cold = self._hot(), self._read("cold", ROWS)
        heads = self._read("segments", SEGMENTS)
        first = heads.select("start_pos", "first").unionByName(hot.groupBy().agg(F.min_by("token", "pos").alias("first"), F.min("pos").alias("start_pos")).where("first is not null"))
        borders = heads.select(F.col("last").alias("token"), (F.col("start_pos") + F.col("token_count")).alias("start_pos")).join(first, "start_pos", "left")
        borders = borders.select("token", (F.col("start_pos") - 1).alias("pos"), F.col("first").alias("next"))
        return cold.where("next is not null").unionByName(borders).unionByName(hot)

    def corpus(self) -> Corpus:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in TOKEN_ROWS.fields[2:]]
        return Corpus(self.spark.createDataFrame([], FILES), self.rows().select("token", "pos", *none, "next"))

    def segment(self, pos: Column) -> Column:
        return F.floor(pos / self.size).cast("long")

    def segments(self) -> DataFrame:
        """segment, start_pos, token_count, bytes and whether the segment is full (cold) or the last one (hot)."""
        hot = self._hot().groupBy(self.segment(F.col("pos")).alias("segment")).agg(F.min("pos").alias("start_pos"), F.count("*").alias("token_count"), (F.sum(json_bytes(F.col("token"))) + 1).alias("bytes"), F.lit(False).alias("cold"))
        return self._read("segments", SEGMENTS).drop("first", "last").withColumn("cold", F.lit(True)).unionByName(hot)

    def stats(self) -> DataFrame:
        """One row: hot_tokens, cold_segments, total_tokens and cold_bytes, the lengths of the cold segments as JSON lists."""
        cold = F.col("cold")
        of = lambda value, on: F.coalesce(F.sum(F.when(on, value)), F.lit(0)).cast("long")
        return self.segments().agg(of(F.col("token_count"), ~cold).alias("hot_tokens"), F.count(F.when(cold, 1)).alias("cold_segments"), of(F.col("token_count"), F.lit(True)).alias("total_tokens"), of(F.col("bytes"), cold).alias("cold_bytes"))

    def phrase(self, words: list[str], window: int = 15) -> DataFrame:
        """position and left_context of a phrase by position, across segment borders."""
        return hits_with_left_context(self.corpus(), words, self.size, window)

    def token_at(self, pos: int) -> DataFrame:
        return self.rows().where(F.col("pos") == pos).select("pos", "token")


def segments_of(tokens: DataFrame, size: int) -> DataFrame:
    seg = F.floor(F.col("pos") / size).cast("long")
    return tokens.groupBy(seg.alias("segment")).agg(F.min("pos").alias("start_pos"), F.count("*").alias("token_count"), (F.count("*") == size).alias("cold"))


def hits_with_left_context(corpus: Corpus, words: list[str], size: int, window: int = 15) -> DataFrame:
    """position and left_context: tokens before and of the phrase, no further back or on than the segment of its start."""
    hits, few = settled(phrase.positions(corpus, words).select("position").distinct())
    k = len(words)
    low = F.greatest(F.col("position") - window, F.floor(F.col("position") / size) * size)
    high = F.least(F.col("position") + k, (F.floor(F.col("position") / size) + 1) * size) - 1
    around = hits.select("position", F.explode(F.sequence(low, high)).alias("pos"))
    each = corpus.looked_up(around, few)
    out = each.groupBy("position").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), " ").alias("left_context"))
    return in_order(out, few, "position")


def last_feedback(events: DataFrame, last: int = 10) -> DataFrame:
    """A stream of query and confidence from a stream of (query, valid): the mean of each query's last events, kept as state."""
    from collections.abc import Iterator

    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = list(state.get[0]) if state.exists else []
        for b in batches:
            old = (old + [float(v) for v in b["valid"]])[-last:]
        state.update((old,))
        yield pd.DataFrame({"query": [key[0]], "confidence": [sum(old) / len(old)], "n": [len(old)]})

    return events.groupBy("query").applyInPandasWithState(step, "query string, confidence double, n long", "v array<double>", "update", "NoTimeout")
