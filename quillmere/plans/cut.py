"""Lineage cuts that survive the loss of an executor.

Iterative operators write their intermediate tables as Parquet into the shared folder named by
``spark.checkpoint.dir``; every executor can read them again.  Where the setting is missing, a local
session (tests) gets a temporary folder, which is removed at the end; on a cluster that is an error,
as its executors share no machine's folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    place = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmere-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = "file://" + folder
        spark.conf.set(KEY, place)
    return place.rstrip("/")


class Cut:
    """A written table: ``df`` reads it, ``drop()`` removes its files once nothing reads it any more."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/quillmere/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back."""
    return Cut(df, tag).df


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
