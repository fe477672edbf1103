"""A vector collection kept as a Parquet table: get or create, add, query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.operators.embed import Embedder, HashingEmbedder
from quillmere.operators.similarity import units
from quillmere.plans.cut import cut
from quillmere.schemas import COLLECTION

#: Query vectors a broadcast holds; more queries are answered block by block.
QUERY_BLOCK = 8192
#: Queries and vectors whose distances are held at once.
SUB_BLOCK = 1024


def _few_nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the k nearest of each query, ties by place; the vectors are handled in blocks."""
    row, col, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for b in range(0, len(x), SUB_BLOCK):
        distance = 1 - q @ x[b : b + SUB_BLOCK].T
        least = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if distance.shape[1] > k else np.full((len(q), 1), np.inf)
        r, c = np.nonzero(distance <= least)
        row, col, value = np.concatenate([row, r]), np.concatenate([col, c + b]), np.concatenate([value, distance[r, c]])
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        first = np.searchsorted(row, row)  # rows are sorted, so this is where each query begins
        keep = np.arange(len(row)) - first < k
        row, col, value = row[keep], col[keep], value[keep]
    return row, col, value


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, id, distance): exact k nearest by cosine distance, ties by id.

    ``vectors`` has (id, embedding), ``queries`` (query_id, embedding).  A bounded block of queries goes to
    the workers, each batch of vectors keeps its k best a query, and a window ranks what is left."""
    asked = queries.where("query_id is not null and embedding is not null")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    rows = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    kind, id_kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "id")))
    every = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toArrow()
        shipped = vectors.sparkSession.sparkContext.broadcast((part.column(0).to_pylist(), units(part.column(1))))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, q = shipped.value
            for batch in batches:
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), units(batch.column(1))
                if not len(ids) or not len(names):
                    continue
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                for a in range(0, len(names), SUB_BLOCK):
                    row, col, value = _few_nearest(q[a : a + SUB_BLOCK], x, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[a + r] for r in row.tolist()]), pa.array(ids[col]), pa.array(value)], names=["query_id", "id", "distance"]
                    )

        answer = rows.mapInArrow(run, f"query_id {kind}, id {id_kind}, distance double")
        every = answer if every is None else every.union(answer)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def add(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``existing`` and those of ``new`` whose id it lacks; of a new id that comes twice the first text stays."""
    first = new.groupBy("id").agg(F.min("document").alias("document"))
    return existing.select("id", "document").unionByName(first.join(existing.select("id"), "id", "left_anti"))


def numbered(documents: DataFrame, start: int) -> DataFrame:
    """(id, document) with the ids doc{start + 1}, doc{start + 2} and so on, without moving the rows."""
    rows = cut(documents.select("document", F.monotonically_increasing_id().alias("place")), "numbered")
    part = F.shiftright("place", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + start).alias("offset"))
    in_part = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    with_offset = rows.withColumn("part", part).join(offsets, "part")
    return with_offset.select(F.concat(F.lit("doc"), (F.col("offset") + in_part + 1).cast("string")).alias("id"), "document")


class Collection:
    """``Collection(spark, path)`` opens the table at ``path`` or creates it; the embedder's name is stored with the rows."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.embedder = spark, path, embedder or HashingEmbedder()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            spark.createDataFrame([], COLLECTION).write.parquet(path)
        other = self.table().where(F.col("embedder") != self.embedder.name).select("embedder").first()
        if other:
            raise ValueError(f"the collection was made with the embedder {other['embedder']}")

    def table(self) -> DataFrame:
        return self.spark.read.schema(COLLECTION).parquet(self.path)

    def add_documents(self, documents: DataFrame) -> None:
        """Appends (document) or (id, document) rows; ids that exist are ignored, missing ids go on from the count."""
        if "id" not in documents.columns:
            documents = numbered(documents, self.table().count())
        fresh = documents.groupBy("id").agg(F.min("document").alias("document")).join(self.table().select("id"), "id", "left_anti")
        rows = fresh.select("id", "document", self.embedder.column(F.col("document")).alias("embedding"), F.lit(self.embedder.name).alias("embedder"))
        rows.write.mode("append").parquet(self.path)

    def query(self, texts: DataFrame, n_results: int = 3) -> DataFrame:
        """(query_id, rank, id, document, distance) for rows (query_id, text)."""
        asked = texts.select("query_id", self.embedder.column(F.col("text")).alias("embedding"))
        got = nearest(self.table(), asked, n_results)
        return got.join(self.table().select("id", "document"), "id").select("query_id", "rank", "id", "document", "distance")
