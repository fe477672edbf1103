"""The embedding cache, keyed by the checksum of the raw content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.schemas import CACHE


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``, or an empty one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A cache kept as one JSON object of checksum to vector."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("checksum", "embedding"))


def hits(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """``documents`` (with a checksum) and whether the cache has them; the cache's repeated keys count once."""
    known = cache.where(F.col("checksum").isNotNull()).select("checksum").distinct().withColumn("cached", F.lit(True))
    return documents.join(known, "checksum", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def misses(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """One row for each checksum to be embedded."""
    return documents.join(cache.select("checksum"), "checksum", "left_anti").dropDuplicates(["checksum"])


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new rows; an entry that exists stays."""
    return cache.unionByName(new.join(cache.select("checksum"), "checksum", "left_anti").dropDuplicates(["checksum"]))


def save(cache: DataFrame, path: str) -> None:
    """Writes beside the old cache, then swaps, so that a failed run leaves the old one."""
    spark = cache.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".old")]
    fs = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    cache.write.mode("overwrite").parquet(path + ".new")
    fs.delete(paths[2], True)
    if fs.exists(paths[0]):
        fs.rename(paths[0], paths[2])
    fs.rename(paths[1], paths[0])
    fs.delete(paths[2], True)
