"""Queries of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import clean_markup, components, language, leaks, main_body, near_duplicates, neighbours, split, subjects, tokenize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def queries():
    t = table
    return {
        "p1_found": lambda s, d: components.found(s, t(s, d, "file_matches")),
        "p1_groups": lambda s, d: components.groups(s, t(s, d, "file_matches")),
        "p8_ids": lambda s, d: tokenize.encode(t(s, d, "documents")),
        "p8_round_trip": lambda s, d: tokenize.round_trip(t(s, d, "documents")),
        "p10_found": lambda s, d: language.found(t(s, d, "documents")),
        "p10_segments": lambda s, d: language.segments(t(s, d, "documents")),
        "p9_found": lambda s, d: leaks.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p3_found": lambda s, d: near_duplicates.found(t(s, d, "md_files")),
        "p3_classes": lambda s, d: near_duplicates.classes(t(s, d, "md_files")),
        "p2_found": lambda s, d: neighbours.found(t(s, d, "embedding_cache")),
        "p4_found": lambda s, d: split.found(t(s, d, "md_files")),
        "p4_pieces": lambda s, d: split.split(t(s, d, "md_files")),
        "p5_found": lambda s, d: main_body.found(t(s, d, "html_pages")),
        "p5_bodies": lambda s, d: main_body.bodies(t(s, d, "html_pages")),
        "p6_found": lambda s, d: clean_markup.found(t(s, d, "md_files"), t(s, d, "html_pages")),
        "p6_cleaned": lambda s, d: clean_markup.cleaned(t(s, d, "md_files"), t(s, d, "html_pages")),
        "p7_found": lambda s, d: subjects.found(
            t(s, d, "md_files"), t(s, d, "category_lines"), t(s, d, "subject_labels"), t(s, d, "subject_areas")
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {}
