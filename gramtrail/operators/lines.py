"""Lines by their places in bytes: where each begins, and the line of any place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Bytes of a bucket in which places meet lines.
BUCKET = 4096


def line_table(files: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, line_no (from 1), line, byte_start and byte_end, the place after its line end; a sum along the lines of a file, of which no line knows the others."""
    each = files.select("doc_id", F.posexplode(X.lines(F.col(content))).alias("i", "line"))
    before = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    out = each.withColumn("byte_start", F.coalesce(before, F.lit(0)))
    return out.select("doc_id", (F.col("i") + 1).alias("line_no"), "line", "byte_start", (F.col("byte_start") + F.octet_length("line") + 1).alias("byte_end"))


def at_bytes(lines: DataFrame, places: DataFrame, byte: str = "byte") -> DataFrame:
    """places(doc_id, a byte place, ...) with line_no; a place behind the last line is of that line, one before the first of the first.

    Places and lines meet by file and bucket of 4,096 bytes, so that neither a long file nor many places are one group.
    """
    ends = lines.groupBy("doc_id").agg(F.max("byte_end").alias("__end"))
    inside = places.join(ends, "doc_id").withColumn("__at", F.greatest(F.least(F.col(byte), F.col("__end") - 1), F.lit(0)))
    inside = inside.withColumn("__bucket", F.floor(F.col("__at") / BUCKET))
    spread = lines.select("doc_id", "line_no", "byte_start", "byte_end", F.explode(F.sequence(F.floor(F.col("byte_start") / BUCKET), F.floor((F.col("byte_end") - 1) / BUCKET))).alias("__bucket"))
    found = inside.join(spread, ["doc_id", "__bucket"]).where("__at >= byte_start AND __at < byte_end")
    return found.select(*[found[c] for c in places.columns], "line_no")


def estimated_bytes(tokens: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """tokens(doc_id, local_pos, ...) with byte: where a token would stand if all of a file's took the same room."""
    size = files.select("doc_id", "token_count", F.octet_length(content).alias("__bytes"))
    return tokens.join(size, "doc_id").withColumn("byte", F.floor(F.col("local_pos") / F.col("token_count") * F.col("__bytes")).cast("long")).drop("__bytes", "token_count")
