"""Problem 6: markup residue in text documents.

Method: equivalence-class template deduction.  A token is what a unit of a page says: its start tag, its
words and its end tag (``main_body.Unit``), and the words of its last link; the name of the site and
digits are left open, as slots.  Tokens of a host's pages that occur equally often on the same pages
share an occurrence vector and form a class.  A class is valid if it has at least ``SIZE`` tags and words,
stands under at least ``SUPPORT`` titles and ``SHARE`` of the host's, and comes in one order on every
page.  Valid classes nest: of two that cross on a page (neither within a slot of the other, nor beside
it) the rarer one is dropped.  The valid classes are the host's template, what remains is in its slots.
Of the slots those of the article are extracted: the scan of ``main_body`` runs over the units with the
template as its only knowledge of other pages, so a slot among tokens of the template (a teaser between
the heading and the link of a side panel) falls with them.

A host under ``SUPPORT`` titles has no template; there what small hosts repeat, taken together, takes its
place.  ``without_template`` gives the share of such pages.

* One pass reads each page and gives a row a page with hashes; vectors are a bitwise sum of hashes over
  titles, so no list of pages is ever collected and a host with a third of all pages is aggregated in parts.
* Order and nesting are checked on the tokens of candidate classes alone.
* Copies, versions and pages fetched again count as one page of the template (by title), each with its
  own rows in the result.
* The clean text of a page is put together from its slots in order.

Markdown, wiki, LaTeX and mixed files have no host and so no template; ``markup.parse`` reads their structure.

Defined cases: null ids, null and empty contents have no elements; pages without URL form a host of
their own; of a file delivered again the text ingested last counts (with equal times the greater text
hash); an element without text isn't one; code blocks and formulas may not be empty either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.main_body import SHARE, SUPPORT, candidates, host_sizes, page_key, page_rows, pooled, scanned, text_hash
from quillmere.llm.markup import KINDS, parse
from quillmere.plans.cut import cut

#: Tags and words of a class.
SIZE = 3


def template(rows: DataFrame) -> DataFrame:
    """(host, token) of the valid equivalence classes of page rows."""
    first = rows.groupBy("host", "title").agg(F.min("key").alias("key"))  # versions and copies are one page
    once = rows.select("host", "title", "key", "tokens", "links", "words").join(first, ["host", "title", "key"], "left_semi").dropDuplicates(["key"])
    on = candidates(once).groupBy("host", "token", "title").agg(
        F.count("*").alias("times"), F.min("place").alias("place"), F.max("place").alias("last"), (F.max("words") + 2).alias("size")
    )
    on = cut(on, "on")
    vector = on.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("title", "times")).alias("v1"), F.bit_xor(F.xxhash64("times", "title", F.lit(7))).alias("v2"),
        F.count("*").alias("titles"), F.max("size").alias("size"),
    ).where(F.col("titles") >= SUPPORT)
    often = vector.join(host_sizes(rows), "host").where(F.col("titles") >= SHARE * F.col("of"))
    sizes = often.groupBy("host", "v1", "v2").agg(F.sum("size").alias("size")).where(F.col("size") >= SIZE)
    classes = cut(often.join(sizes.drop("size"), ["host", "v1", "v2"], "left_semi").select("host", "token", "v1", "v2", "titles"), "classes")
    placed = on.join(classes, ["host", "token"])
    # the order of a class is that of its mean places; a page on which a token comes before one of a lower rank breaks it
    mean = placed.groupBy("host", "token").agg(F.avg("place").alias("mean"))
    line = Window.partitionBy("host", "v1", "v2", "title").orderBy("mean", "token")
    step = placed.join(mean, ["host", "token"]).withColumn("step", F.col("place") - F.lag("place").over(line))
    spans = step.groupBy("host", "v1", "v2", "title").agg(
        F.min("step").alias("step"), F.min("place").alias("lo"), F.max("last").alias("hi"), F.max("titles").alias("titles"), F.count("*").alias("n")
    )
    broken = spans.where("step < 0").select("host", "v1", "v2").distinct()
    # classes of one token can't cross; a page has few of the others
    wide = spans.where("n > 1").join(broken, ["host", "v1", "v2"], "left_anti").select("host", "title", "v1", "v2", "lo", "hi", "titles")
    other = wide.select("host", "title", *(F.col(c).alias(f"o_{c}") for c in ("v1", "v2", "lo", "hi", "titles")))
    pairs = wide.join(other, ["host", "title"]).where("lo < o_lo and o_lo <= hi and hi < o_hi")
    rank = lambda p: F.struct(F.col(p + "titles"), F.col(p + "v1"), F.col(p + "v2"))
    rarer = F.when(rank("") < rank("o_"), F.struct("v1", "v2")).otherwise(F.struct(F.col("o_v1").alias("v1"), F.col("o_v2").alias("v2")))
    crossed = pairs.select("host", rarer.alias("x")).select("host", "x.v1", "x.v2").distinct()
    valid = classes.join(broken, ["host", "v1", "v2"], "left_anti").join(crossed, ["host", "v1", "v2"], "left_anti")
    return valid.select("host", "token")


def evidence(rows: DataFrame) -> DataFrame:
    """(host, token): the templates; hosts too small for one have what small hosts repeat, taken together."""
    small = host_sizes(rows).where(F.col("of") < SUPPORT).select("host")
    return template(rows).union(pooled(rows).join(small, "host", "left_semi"))


def without_template(pages: DataFrame) -> DataFrame:
    """(pages, small): the number of pages with content, and of those whose host has too few titles for a template."""
    rows = page_rows(pages).select("host", "title")
    return rows.join(host_sizes(rows), "host").agg(F.count("*").alias("pages"), F.count_if(F.col("of") < SUPPORT).alias("small"))


def page_elements(pages: DataFrame) -> DataFrame:
    """(row_id, heading, list_item, code_block, formula) of what the article's slots hold."""

    def handle(keep: list[bool], page: int, held: list[list[int]], formulas: list[int]) -> tuple:
        codes = {b for x, good in zip(held, keep) if good for b in x}
        return (page, *(sum(b % 4 == kind for b in codes) for kind in range(3)), sum(k for k, good in zip(formulas, keep) if good))

    rows = cut(page_rows(pages), "pages")
    schema = "row_id bigint, " + ", ".join(f"{k} bigint" for k in KINDS)
    counted = scanned(rows, evidence(rows), ["page_id", "blocks", "formulas"], handle, schema, (pa.int64(),) * 5)
    return counted.groupBy("row_id").agg(*(F.max(k).alias(k) for k in KINDS))  # of rows of one id and different content the greater numbers


def file_elements(files: DataFrame) -> DataFrame:
    """(row_id, heading, list_item, code_block, formula) of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, when, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = parse(text).counts()
                out.append((file, when, text_hash(text), *(counts[k] for k in KINDS)))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row_id", "ingested", "text_key", *KINDS])

    when = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(0))
    rows = files.select(F.col("file_id").cast("long"), when.cast("long"), F.col("content").cast("string").alias("text")).where(
        "file_id is not null and length(text) > 0"
    )
    counted = rows.mapInArrow(run, "row_id bigint, ingested bigint, text_key bigint, " + ", ".join(f"{k} bigint" for k in KINDS))
    last = counted.groupBy("row_id").agg(F.max(F.struct("ingested", "text_key", *KINDS)).alias("x"))
    return last.select("row_id", *(F.col(f"x.{k}").alias(k) for k in KINDS))


def found(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(origin, row_id, kind, item_no): one row for each element to be kept."""
    both = file_elements(files).select(F.lit("md_files").alias("origin"), "row_id", *KINDS).union(
        page_elements(pages).select(F.lit("html_pages").alias("origin"), "row_id", *KINDS)
    )
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS))
    long = both.select("origin", "row_id", F.inline(pairs)).where("n > 0")
    return long.select("origin", "row_id", "kind", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("item_no"))


def _bare(formula: str) -> str:
    return re.sub(r"^\s*(?:\$\$|\\\[|\\\(|\$)\s*|\s*(?:\$\$|\\\]|\\\)|\$)\s*$", "", formula).strip()


def assembled(units: list[tuple[list[int], list[dict]]]) -> str:
    """The text of a page's units, (blocks, text nodes), in order: a line a unit, marked as in the clean text of files."""
    lines: list[str] = []
    seen: set[int] = set()
    for blocks, nodes in units:
        fresh = [b for b in blocks if b % 4 < 3 and b not in seen]
        seen.update(fresh)
        mark = "".join(("# ", "- ", "")[b % 4] for b in fresh)
        pieces: list[tuple[bool, str]] = []  # (formula, text)
        for j, x in enumerate(nodes):
            before = x["before"] if j else ""
            if x["formula"] and pieces and pieces[-1][0]:
                pieces[-1] = (True, pieces[-1][1] + before + x["text"])
            else:
                pieces += [(False, before), (x["formula"], x["text"])]
        text = "".join(f"${' '.join(_bare(t).split())}$" if formula else t for formula, t in pieces)
        if any(b % 4 == 2 for b in blocks):
            lines += [mark.strip()] if mark else []
            lines.append("```\n" + text.strip("\n") + "\n```")
        else:
            lines.append(mark + " ".join(text.split()))
    return "\n".join(lines)


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(row_id, clean): the clean text of every row of ``pages``; null stays null, a page without main body is empty."""

    def handle(keep: list[bool], key: int, held: list[list[int]], parts: list[list[dict]]) -> tuple:
        return key, assembled([u for u, good in zip(zip(held, parts), keep) if good])

    rows = cut(page_rows(pages, texts=True, with_null_ids=True), "pages")
    repeated = evidence(rows.where("page_id is not null"))
    clean = scanned(rows.dropDuplicates(["key"]), repeated, ["key", "blocks", "parts"], handle, "key bigint, clean string", (pa.int64(), pa.string()))
    every = pages.select(F.col("page_id").cast("long").alias("row_id"), F.col("html_content").isNotNull().alias("there"), page_key().alias("key"))
    return every.join(clean, "key", "left").select("row_id", F.when(F.col("there"), F.coalesce("clean", F.lit(""))).alias("clean"))


def cleaned_files(files: DataFrame) -> DataFrame:
    """(row_id, clean): the clean text of every row of ``files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [parse(t, render=True).text if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row_id", "clean"])

    return files.select(F.col("file_id").cast("long"), F.col("content").cast("string")).mapInArrow(run, "row_id bigint, clean string")


def cleaned(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(origin, row_id, clean): the clean text of every row of both tables."""
    of = lambda name, df: df.select(F.lit(name).alias("origin"), "row_id", "clean")
    return of("md_files", cleaned_files(files)).union(of("html_pages", cleaned_pages(pages)))
