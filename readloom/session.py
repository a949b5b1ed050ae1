"""Session settings and the place where jobs cut their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs rely on for speed, never for results."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without
    that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="readloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into the configured number of partitions.

    Adaptive execution merges partitions by their size in bytes. Steps that
    compute long on few bytes would end up in few tasks that way, so their
    number of partitions is stated.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def in_runs(reads: DataFrame, run: int = 1024) -> DataFrame:
    """Reads dealt out in runs of consecutive ids, in order within a partition.

    Numbering leaves 65,536 ids in a partition; a stored read set should keep
    all tasks of the steps that read it busy.
    """
    deal = F.floor(F.col("read_id") / run)
    return spread(reads.withColumn("__run", deal), "__run").drop("__run").sortWithinPartitions("read_id")


DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write a table, and leave no shuffle files of the job that makes it: nothing reads them once the table is there."""
    conf = df.sparkSession.conf
    before = conf.get(DROPPED, None)
    conf.set(DROPPED, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            conf.unset(DROPPED)
        else:
            conf.set(DROPPED, before)


class Workspace:
    """Tables of one run, written to the shared folder.

    ``keep`` writes a table and reads it back: the result has no lineage but
    the files, so a lost executor costs a re-read and not a re-computation.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or os.path.join(shared_folder(spark), f"run-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        write_table(df, self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def stage(self, name: str, make) -> DataFrame:
        """``keep`` the result of ``make()``, unless an earlier run of the same
        workspace finished this stage."""
        if not self.finished(name):
            write_table(make(), self.path(name))
        return self.spark.read.parquet(self.path(name))

    def finished(self, name: str) -> bool:
        jvm = self.spark._jvm
        marker = jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)
