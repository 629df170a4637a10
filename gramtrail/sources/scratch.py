"""Tables between jobs, in the shared folder that the session names, and numbers in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; in a local session without that setting, a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{given.rstrip('/') if given else 'file://' + tempfile.mkdtemp(prefix='gramtrail-')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: made once, with their lineage cut."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(rows: DataFrame) -> None:
    """Delete the table that written or ranked rows are read from, once nothing reads them any more."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    for at in {f.rpartition("/")[0] for f in rows.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at))
        p.getFileSystem(conf).delete(p, True)


def ranked(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """The rows with their number from 0 in a global order: sampled ranges of it are sorted apart, and counts of the ranges are summed."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place}))
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(parts), "__part").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")
