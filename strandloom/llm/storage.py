"""Where jobs cut their lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: A job's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of one to three 8-byte columns up to which a side may be broadcast (about 12 MB once hashed); beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Rows of one key in a join beyond which the key's partner is broadcast instead of sending all its rows to one task.
HOT_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode, as in tests."""
    at = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


class Tables:
    """Parquet tables of one job in the shared folder; those that nothing reads any more can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.root = f"{shared_dir(spark).rstrip('/')}/strandloom-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: computed once, and safe when executors are lost.

        What reads the table needs none of the shuffle files behind it, so they are dropped once it is written.
        """
        path = f"{self.root}/{name}-{len(self.paths)}"
        before = self.spark.conf.get(CLEANUP_KEY, "false")
        self.spark.conf.set(CLEANUP_KEY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP_KEY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes the files of these tables."""
        for path in [p for p, df in self.paths.items() if any(df is t for t in tables)]:
            self._remove(path)

    def keep(self, *tables: DataFrame) -> None:
        """Removes the files of all other tables."""
        for path in [p for p, df in self.paths.items() if not any(df is t for t in tables)]:
            self._remove(path)

    def _remove(self, path: str) -> None:
        if self.paths[path] is not None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths[path] = None


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder."""
    return Tables(df.sparkSession).written(df, name)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; otherwise unchanged, so that the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def joined_on(rows: DataFrame, side: DataFrame, on: list[str], tables: Tables) -> DataFrame:
    """rows joined with a written side that has one row a key and counts the key's rows in n.

    Keys with more than HOT_ROWS rows would each fill one task. They are few, as so many rows are behind each, and are
    broadcast after they were counted; all others are shuffled.
    """
    hot = tables.written(side.where(F.col("n") > HOT_ROWS), "hot")
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return rows.join(side.drop("n"), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(side.where(F.col("n") <= HOT_ROWS).drop("n"), on)
    return rows.join(F.broadcast(hot.drop("n")), on).unionByName(rest)
