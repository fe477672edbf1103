"""Command line: group similar Markdown files, convert HTML folders, tag files with categories."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere import sources
from quillmere.functions import categories, markdown, tokens
from quillmere.operators import cache, html, similarity
from quillmere.operators.embed import Completer, EchoCompleter, Embedder, HashingEmbedder
from quillmere.plans.session import session


def group(spark: SparkSession, folder: str, cache_path: str, threshold: float = 0.9, embedder: Embedder | None = None) -> DataFrame:
    """(vec_id, report) of the files of a folder; vectors come from the cache, and missing ones go into it.

    Files over the embedding limit are left out unless the cache has their vector."""
    embedder = embedder or HashingEmbedder()
    files = sources.read_markdown(spark, folder).withColumn("vec_id", F.xxhash64("name"))
    old = cache.load(spark, cache_path)
    prepared = cache.misses(files, old).select("checksum", markdown.prepare(F.col("text")).alias("prepared"))
    short = prepared.where(tokens.estimated(F.col("prepared")) <= tokens.EMBEDDABLE)
    new = short.select("checksum", embedder.column(F.col("prepared")).alias("embedding"))
    cache.save(cache.upsert(old, new), cache_path)
    vectors = files.join(cache.load(spark, cache_path), "checksum").select("vec_id", "embedding")
    grouped = similarity.groups(similarity.pairs(vectors, threshold))
    return similarity.report(grouped, files.select("vec_id", "name"))


def convert(spark: SparkSession, folder: str, out: str, options: html.Options = html.Options()) -> None:
    """HTML files to Markdown, as a table partitioned by length tier."""
    pages = sources.read_html(spark, folder).where("text is not null")
    named = pages.select(F.regexp_replace("name", r"\.html$", ".md").alias("name"), html.markdown(F.col("text"), options).alias("text"))
    sources.write_by_tier(named, out)


def tag(spark: SparkSession, folder: str, out: str, completer: Completer | None = None) -> None:
    """Category lines of Markdown files; files too long for every model are left out."""
    completer = completer or EchoCompleter()
    files = sources.read_markdown(spark, folder).select("name", markdown.prepare(F.col("text")).alias("prepared"))
    routed = files.withColumn("model", tokens.chat_model(tokens.estimated(F.col("prepared")))).where("model is not null")
    asked = routed.withColumn("messages", categories.messages(F.lit(categories.SYSTEM), categories.user_message(F.col("prepared"))))
    answers = asked.select(F.col("name").alias("filename"), completer.column(F.col("model"), F.col("messages")).alias("message"))
    sources.write_category_lines(answers, out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillmere", description=__doc__)
    todo = p.add_subparsers(dest="command", required=True)
    g = todo.add_parser("group")
    g.add_argument("folder")
    g.add_argument("--cache", default="embeddings_cache")
    g.add_argument("--threshold", type=float, default=0.9)
    g.add_argument("--output")
    for name in ("convert", "tag"):
        c = todo.add_parser(name)
        c.add_argument("folder")
        c.add_argument("output")
    a = p.parse_args(argv)
    spark = session("quillmere")
    if a.command == "group":
        report = group(spark, a.folder, a.cache, a.threshold)
        if a.output:
            sources.write_report(report, a.output)
        else:
            for row in report.select("report").toLocalIterator():
                print(row["report"])
    else:
        {"convert": convert, "tag": tag}[a.command](spark, a.folder, a.output)


if __name__ == "__main__":
    main()
