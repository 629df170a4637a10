"""Connected components by alternating large-star and small-star steps; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """node and root of every node that has a link and is not its own root; links has columns u and v.

    After at most that many rounds, if given: nodes with one root are then of one component, but not all of one component have one root.
    """
    spark = links.sparkSession
    e = written(links.select("u", "v").where("u <> v").distinct(), "links")
    state, rounds = None, 0
    while True:
        rounds += 1
        after = written(_small(_large(e)), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, e)
        e = after
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        if rounds == most:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
