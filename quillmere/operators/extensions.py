"""Announced by the reference, not built there: sections, fixed-size chunks, retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header_sections(text: Column) -> Column:
    """The parts of a Markdown text, each from one header line to the next; text above the first header is a part."""
    marked = F.regexp_replace(text, r"(?md)^(#{1,6}[ \t])", "\u0001$1")
    return F.filter(F.split(marked, "\u0001", -1), lambda x: x != "")


def chunks(documents: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, chunk): pieces of ``size`` code points, each beginning ``size - overlap`` after the last one."""
    step = size - overlap
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(n - overlap, F.lit(1)) / step).cast("int") - 1)
    rows = documents.where(n > 0).select(id_col, text_col, F.explode(starts).alias("k"))
    return rows.select(
        id_col, (F.col("k") + 1).cast("long").alias("chunk_no"), F.substr(F.col(text_col), F.col("k") * step + 1, F.lit(size)).alias("chunk")
    )


def precision_recall(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall) at k from (query_id, rank, id) and (query_id, id)."""
    top = found.where(F.col("rank") <= k)
    right = top.join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    want = relevant.groupBy("query_id").agg(F.count("*").alias("want"))
    hits = F.coalesce("hits", F.lit(0))
    return want.join(right, "query_id", "left").select("query_id", (hits / k).alias("precision"), (hits / F.col("want")).alias("recall"))
