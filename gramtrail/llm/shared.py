"""Tables that outlive lost executors, in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .textops import small_batches

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and the session is local."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if given:
        return f"{given.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="gramtrail-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, with their lineage cut."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(16 << 20)).parquet(path)  # what a writer holds until it writes
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        at = jvm.org.apache.hadoop.fs.Path(f).getParent()
        at.getFileSystem(conf).delete(at, True)
