"""Tables in the cluster's shared folder, by which long jobs cut their lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a local master gets a temporary one, as in tests; on a
    cluster it is an error, as executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="webweft-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has the file or folder deleted when the application ends, if it is still there then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)


class Stored:
    """A table written once to the shared folder, so that no later step recomputes it.

    It survives lost executors and cuts the lineage. drop() deletes its files, once no
    unread DataFrame depends on them; those that a result is read from go when the application ends.
    """

    def __init__(self, df: DataFrame, tag: str, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(self.path)
        delete_at_end(self.spark, self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now rather than at the next driver GC."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
