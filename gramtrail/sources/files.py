"""Reading corpora: folders of source files, text files, token lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .scratch import ranked


def folder(spark: SparkSession, root: str, pattern: str = "*.rs") -> DataFrame:
    """doc_id, path (below root, with forward slashes) and text of the files of a folder, hidden and build folders left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\\", "/")
    base = F.lit(root.rstrip("/") + "/")
    below = F.expr("substring_index(p, r, -1)")
    rows = rows.select(F.url_decode(path).alias("p"), base.alias("r"), F.col("value").alias("text")).select(below.alias("path"), "text")
    rows = rows.where(~F.col("path").rlike(r"(^|/)(\.[^/]+|target)/"))
    numbers = ranked(rows.select("path"), "path", name="doc_id")  # names alone
    return rows.join(numbers, "path").select("doc_id", "path", "text")


def text_tokens(spark: SparkSession, path: str) -> DataFrame:
    """token and pos of a text file, split at white space."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(X.tokenize(F.col("value"), "space")).alias("pos", "token")).select("token", F.col("pos").cast("long").alias("pos"))


def token_list(spark: SparkSession, tokens: list[str], start: int = 0) -> DataFrame:
    """token and pos of literal tokens."""
    return spark.createDataFrame([(t, start + i) for i, t in enumerate(tokens)], "token string, pos long")
