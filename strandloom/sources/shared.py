"""Tables in the folder that driver and executors share, where long jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below one of our own only in local mode, where it may be unset."""
    at = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a table that is computed once and outlives lost executors."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str, name: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
