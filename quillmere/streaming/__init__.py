"""The same column functions on a stream of new files: stateless, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import markdown, tokens


def cleaned_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """A stream of documents with clean text, token count and tier."""
    clean = stream.withColumn("clean", markdown.clean(F.col(text_col)))
    counted = clean.withColumn("n_tokens", tokens.estimated(F.col("clean")))
    return counted.withColumn("tier", tokens.tier(F.col("n_tokens")))


def event_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; events later than the watermark are left out."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there and stops; the checkpoint makes the next call go on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


def run_whole(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes a bounded input to its end: an aggregate is written in complete mode, with the windows still open and without
    leaving out what is late."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(path)  # each batch holds the whole result

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
