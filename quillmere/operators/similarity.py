"""Cosine similarity joins: pairs over a threshold, groups and the grouping report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions.vectors import cosine
from quillmere.plans.cut import partitions

BLOCK_ROWS = 4096


def units(lists: pd.Series | pa.Array) -> np.ndarray:
    """Rows at length one; zero rows stay zero."""
    x = np.array(lists.to_pylist() if isinstance(lists, (pa.Array, pa.ChunkedArray)) else list(lists), np.float64)
    if not len(x):
        return x.reshape(0, 0)
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size == 0, 1, size)[:, None]


def pairs_by_expression(vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_a, vec_b, cosine) as a theta join: for small tables, and the plainest statement of the result."""
    a = vectors.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("x"))
    b = vectors.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("y"))
    both = a.join(b, F.col("vec_a") < F.col("vec_b")).withColumn("cosine", cosine(F.col("x"), F.col("y")))
    return both.where(F.col("cosine") > threshold).select("vec_a", "vec_b", "cosine")


def pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same by blocks: each pair of blocks meets once, in one task of bounded memory, as a matrix product.

    Rows are dealt to blocks by the hash of their id; a row is sent to as many block pairs as there are
    blocks, and nothing is broadcast.  Null ids and null vectors take no part."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    blocks = max(1, -(-rows.count() // block_rows))
    home = rows.withColumn("home", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = home.select("vec_id", "embedding", "home", F.explode(others).alias("other")).select(
        (F.least("home", "other") * blocks + F.greatest("home", "other")).alias("cell"), "home", "vec_id", "embedding"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cell(table: pa.Table) -> pa.RecordBatch:
            key = table.column(0)[0].as_py()
            first, second = divmod(key, blocks)
            side, ids, x = table.column(1).to_numpy(), table.column(2).to_numpy(), units(table.column(3))
            left, right = side == first, side == second
            s = x[left] @ x[right].T
            i, j = np.nonzero(s > threshold)
            p, q = ids[left][i], ids[right][j]
            keep = p < q if first == second else np.ones(len(p), bool)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(p, q)[keep]), pa.array(np.maximum(p, q)[keep]), pa.array(s[i, j][keep])], names=["vec_a", "vec_b", "cosine"]
            )

        current = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if current is not None and keys[a] != current:
                    yield cell(pa.Table.from_batches(held))
                    held = []
                current = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield cell(pa.Table.from_batches(held))

    spread = dealt.repartition(max(partitions(vectors), 1), "cell").sortWithinPartitions("cell")
    return spread.mapInArrow(run, "vec_a bigint, vec_b bigint, cosine double")


def groups(similar: DataFrame) -> DataFrame:
    """(vec_id, similar): each vector's later partners in ascending order; vectors without one are left out."""
    return similar.groupBy(F.col("vec_a").alias("vec_id")).agg(F.array_sort(F.collect_list("vec_b")).alias("similar"))


def report(grouped: DataFrame, names: DataFrame) -> DataFrame:
    """(vec_id, report): the lines that tell which files are similar.  ``names`` has (vec_id, name)."""
    partner = names.select(F.col("vec_id").alias("partner"), F.col("name").alias("partner_name"))
    long = grouped.select("vec_id", F.explode("similar").alias("partner")).join(partner, "partner")
    lines = long.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("partner", "partner_name"))).alias("p"))
    text = F.concat(
        F.lit("File: "), F.col("name"), F.lit(" is similar to:\n"), F.array_join(F.transform("p", lambda x: F.concat(F.lit(" - "), x["partner_name"])), "\n")
    )
    return lines.join(names, "vec_id").select("vec_id", text.alias("report"))
