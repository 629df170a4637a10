"""Postings as bitmaps: one for each token and bucket of 32,768 positions, and phrases as the AND of shifted ones.

For words that stand nearly everywhere a bitmap is much smaller than a row for each place, and a phrase of such words is found without joining their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import Corpus

#: Positions of one container of the estimate of size, and how many of them are kept as numbers of two bytes before bits take less.
CONTAINER, SPARSE = 1 << 16, 4096


def postings(corpus: Corpus, tokens: DataFrame | None = None) -> DataFrame:
    """token, bucket, bitmap and n of all tokens, or of those given as rows(token, pos)."""
    rows = (corpus.tokens if tokens is None else tokens).select("token", (F.col("pos") + 1).alias("p"))  # the functions count from 1
    bucket = F.bitmap_bucket_number("p").alias("bucket")
    return rows.groupBy("token", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"), F.count("*").alias("n"))


def positions_of(bitmaps: DataFrame, bitmap: str = "bitmap") -> DataFrame:
    """The other columns and position of each bit that is set; bytes without any are passed over."""
    others = [c for c in bitmaps.columns if c not in (bitmap, "bucket")]
    each = bitmaps.select(*others, "bucket", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(bitmap)), lambda i: F.substring(bitmap, i, F.lit(1)))).alias("i", "b"))
    each = each.where(F.col("b") != F.lit(bytearray(b"\0"))).withColumn("v", F.conv(F.hex("b"), 16, 10).cast("int"))
    bits = each.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(F.expr("shiftright(v, bit) & 1 = 1"))
    return bits.select(*others, ((F.col("bucket") - 1) * 32768 + F.col("i") * 8 + F.col("bit")).cast("long").alias("position"))


def phrase(corpus: Corpus, words: list[str]) -> DataFrame:
    """position of each occurrence of a phrase: the bitmaps of its words, shifted to where the phrase begins, share a bit there."""
    places = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(i).alias("off")) for i, w in enumerate(words)])
    rows = corpus.tokens.where(F.col("token").isin(words)).select("token", "pos", F.explode(places).alias("w")).where("w.token = token").select(F.col("w.off").alias("off"), (F.col("pos") - F.col("w.off") + 1).alias("p")).where("p > 0")
    own = rows.groupBy("off", F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    both = own.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("k")).where(F.col("k") == len(words)).drop("k")
    return positions_of(both)


def stored_bytes(containers: DataFrame) -> DataFrame:
    """token and the bytes that its postings take as a bitmap of containers(token, n), those with up to 4,096 numbers as such and the others as bits."""
    one: Column = 8 + F.least(2 * F.col("n"), F.lit(2 * SPARSE))
    return containers.groupBy("token").agg((F.sum(one) + 8).cast("long").alias("bytes"))


def sizes(corpus: Corpus) -> DataFrame:
    """token and the bytes of its postings."""
    return stored_bytes(corpus.tokens.groupBy("token", F.floor(F.col("pos") / CONTAINER).alias("c")).agg(F.count("*").alias("n")))
