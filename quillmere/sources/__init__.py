"""Readers and writers of folders, caches and category files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.categories import output_lines
from quillmere.functions.tokens import estimated, tier


def read_folder(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name, text) of the files of one folder, not of its subfolders; files that vanish meanwhile are left out."""
    rows = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", False)
        .option("ignoreMissingFiles", True)
        .load(folder)
    )
    return rows.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    return read_folder(spark, folder, "*.html")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text, checksum)."""
    return read_folder(spark, folder, "*.md").withColumn("checksum", F.sha2("text", 256))


def read_category_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def write_by_tier(documents: DataFrame, path: str) -> None:
    """Writes (name, text) as Parquet, partitioned by length tier, so that a reader of one tier skips the others."""
    documents.withColumn("tier", tier(estimated(F.col("text")))).write.mode("overwrite").partitionBy("tier").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a grouping report as text files."""
    report.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_category_lines(responses: DataFrame, path: str) -> None:
    """The category lines of (filename, message) rows as text files."""
    responses.select(F.explode(output_lines(F.col("filename"), F.col("message"))).alias("value")).write.mode("overwrite").text(path)
