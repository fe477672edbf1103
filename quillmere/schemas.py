"""Schemas of the engine's own tables."""

from pyspark.sql import types as T

CACHE = T.StructType([T.StructField("checksum", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
COLLECTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("embedder", T.StringType()),
    ]
)
DOCUMENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
