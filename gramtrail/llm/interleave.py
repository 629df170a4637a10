"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; a row's fractional rank is
(rank + 1/2) / rows of its source. In the order of fractional ranks every source is spread evenly, so
cuts at equal counts give shards that all match the mixture, of sizes at most one row apart (law `rows`).

Both orders are range-partitioned with hash or rank as part of the key, so that a source with a third
of the rows is spread over many tasks; positions come from counts by partition. Cases: a null source is a source of
its own; a null text has size 1 and the checksum of nothing; equal ids rank by checksum; repeated rows get places
of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARDS, SEED = 16, 2026
BEFORE = (Window.unboundedPreceding, -1)


def _placed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows in a global order, written, with the partition and the place in it."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return written(out.select("*", F.spark_partition_id().alias("part"), place.alias("place")), name)


def interleave(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32")
    ).withColumns({"kind": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "h": F.xxhash64(F.lit(seed), "doc_id", "text_crc32")})
    one = _placed(written(rows, "shard-rows"), "shard-ranks", "kind", "h", "doc_id", "text_crc32")
    # A source has a run of places in each partition that holds it: few rows, one for each source and partition.
    runs = one.groupBy("kind", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    by_kind = Window.partitionBy("kind")
    runs = runs.select("kind", "part", "first", F.coalesce(F.sum("n").over(by_kind.orderBy("part").rowsBetween(*BEFORE)), F.lit(0)).alias("before"), F.sum("n").over(by_kind).alias("total"))
    ranked = one.join(runs, ["kind", "part"]).withColumn("rank", F.col("before") + F.col("place") - F.col("first"))
    ranked = ranked.withColumn("share", (F.col("rank") + 0.5) / F.col("total")).select("doc_id", "source", "size", "text_crc32", "kind", "rank", "share")
    two = _placed(ranked, "shard-order", "share", "kind", "rank")
    parts = two.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*BEFORE)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))  # a row for each partition
    at = two.join(F.broadcast(parts), "part").withColumn("at", F.col("before") + F.col("place"))  # as many rows as partitions
    least, more = F.floor(F.col("total") / shards), F.col("total") % shards
    early = F.col("at") < more * (least + 1)
    shard = F.when(early, F.floor(F.col("at") / (least + 1))).otherwise(more + F.floor((F.col("at") - more * (least + 1)) / F.greatest(least, F.lit(1))))
    start = F.when(early, F.col("shard") * (least + 1)).otherwise(more * (least + 1) + (F.col("shard") - more) * least)
    at = at.withColumn("shard", shard.cast("long"))
    return at.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("at") - start).cast("long").alias("slot"))
