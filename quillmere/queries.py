"""Queries of the core operators, each over its whole tables, with the same result in DuckDB's SQL where SQL can tell it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions import categories, markdown, tokens, vectors
from quillmere.functions import release_notes as rn
from quillmere.operators import cache, collection, extensions, html, nlp, similarity
from quillmere.plans.cut import shared_dir
from quillmere.streaming import event_counts, run_whole

COMPANY = "acme"
SIMILAR = 0.3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- release notes: the tables lack issue tracker markup, so it is put round each document ----

_URL = f"https://{COMPANY}.atlassian.net/browse/EW-"


def notes() -> Column:
    """A release note of three rows round a document's text, the second on two lines."""
    n, kind = F.col("doc_id").cast("string"), F.coalesce("content_type", F.lit("none"))
    return F.concat(
        F.lit("## Release  notes\n[ "), n, F.lit(" issues ](https://x.y/q)\n[EW-"), n, F.lit(f"]({_URL}"), n, F.lit(") | [Fix "), kind,
        F.lit(f"]({_URL}"), n, F.lit(") | [![Bug](https://a/i.png)](" + _URL), n,
        F.lit(") | ![Major](https://a/icons/priorities/major.svg) |  \nFixed\n[EW-1"), n, F.lit("] | Bare "), kind,
        F.lit("\nFixed\nKey | Summary | T |\n---|---|---\n"), F.col("text"),
    )


_NOTES_SQL = f"""concat('## Release  notes' || chr(10) || '[ ', doc_id, ' issues ](https://x.y/q)' || chr(10) || '[EW-', doc_id, ']({_URL}', doc_id, ') | [Fix ',
 coalesce(content_type, 'none'), ']({_URL}', doc_id, ') | [![Bug](https://a/i.png)]({_URL}', doc_id, ') | ![Major](https://a/icons/priorities/major.svg) |  '
 || chr(10) || 'Fixed' || chr(10) || '[EW-1', doc_id, '] | Bare ', coalesce(content_type, 'none'), chr(10) || 'Fixed' || chr(10) || 'Key | Summary | T |' || chr(10) || '---|---|---' || chr(10))
 || text"""
_NOTES = f"(SELECT doc_id, content_type, text, {_NOTES_SQL} AS t FROM documents)"
#: What the rewriting must give, told by construction instead of by the rules.
_ROWS_SQL = f"""concat('## Release  notes' || chr(10) || '[ ', doc_id, ' issues ](https://x.y/q)' || chr(10) || '[EW-', doc_id, ']({_URL}', doc_id, ') | Fix ',
 coalesce(content_type, 'none'), ' | Bug | Major | Fixed' || chr(10) || '[EW-1', doc_id, '] | Bare ', coalesce(content_type, 'none'), ' Fixed' || chr(10)
 || 'Key | Summary | T |' || chr(10) || '---|---|---' || chr(10)) || text"""
_FULL_SQL = f"""concat('## Release  notes' || chr(10), doc_id, ' issues' || chr(10) || '[EW-', doc_id, ']({_URL}', doc_id, ') | Fix ',
 coalesce(content_type, 'none'), ' | Bug | Major | Fixed' || chr(10) || '[EW-1', doc_id, ']({_URL}1', doc_id, ') | Bare ', coalesce(content_type, 'none'), ' Fixed' || chr(10)
 || 'Key | Summary | T |' || chr(10) || '---|---|---' || chr(10)) || text"""
_KEYS_SQL = f"""list_reduce(list_transform(string_split(t, chr(10)), lambda l: CASE WHEN regexp_extract(l, '\\[(EW-\\d+)\\]', 1) <> ''
 AND NOT contains(l, '[' || regexp_extract(l, '\\[(EW-\\d+)\\]', 1) || '](https://{COMPANY}.atlassian.net/browse/' || regexp_extract(l, '\\[(EW-\\d+)\\]', 1) || ')')
 THEN replace(l, '[' || regexp_extract(l, '\\[(EW-\\d+)\\]', 1) || ']', '[' || regexp_extract(l, '\\[(EW-\\d+)\\]', 1) || '](https://{COMPANY}.atlassian.net/browse/' || regexp_extract(l, '\\[(EW-\\d+)\\]', 1) || ')')
 ELSE l END), lambda a, b: a || chr(10) || b)"""

# ---- DuckDB forms of the Markdown rules: the plain patterns, as its engine has no look-ahead and no possessive groups ----

_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_STRIP = rf"regexp_replace(%s, '\A{_WS}+|{_WS}+\z', '', 'g')"
_ABOVE = rf"CASE WHEN regexp_matches(%s, '(?m)^{_WS}*#') THEN regexp_extract(%s, '(?ms)^{_WS}*#.*\z') ELSE %s END"
_ATTACH = r"regexp_replace(regexp_replace(%s, '\n## Attachments:(?s:.*)', ''), '(?m)^.*!\[.*?\]\(attachments/.*?\).*$', '', 'g')"
_TRAIL = r"regexp_replace(%s, '(?m)[ \t]+$', '', 'g')"
_FENCE = r"regexp_replace(%s, '(?m)((?:^ {4}.*\n)+(?:^\s*\n(?:^ {4}.*\n)+)*)', E'```\n\\1```\n', 'g')"
_BREAKS = r"regexp_replace(%s, '\n[ \t]*\n[ \t]*\n[ \t\n]*', E'\n\n', 'g')"
_IMAGES = r"regexp_replace(%s, '!\[.*\]\(.*\)', '', 'g')"


def _chain(*steps: str, start: str = "content") -> str:
    sql = start
    for step in steps:
        sql = step.replace("%s", f"({sql})")
    return sql


def _md(change: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "md_files").select("file_id", change(F.col("content")).alias("result"))


def _md_sql(*steps: str) -> str:
    return f"SELECT file_id, {_chain(*steps)} AS result FROM md_files"


def _doc(name: str, change: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "documents").select("doc_id", change().alias(name))


def _note(name: str, change: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "documents").withColumn("t", notes()).select("doc_id", change(F.col("t")).alias(name))


_N = "CAST(ceil(length(text) / 4.0) AS BIGINT)"
_TIER = f"CASE WHEN {_N} <= 3500 THEN 'short' WHEN {_N} < 15000 THEN 'medium' WHEN text IS NOT NULL THEN 'long' END"
_MODEL = f"CASE WHEN {_N} <= 3500 THEN 'gpt-3.5-turbo-1106' WHEN {_N} < 15000 THEN 'gpt-3.5-turbo-16k' END"


def _exact(s: SparkSession) -> Callable[[Column], Column]:
    return tokens.exact(s)


def _estimated(s: SparkSession) -> Callable[[Column], Column]:
    return tokens.estimated


def _counted(name: str, change: Callable[[Column], Column], counter: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "documents").select("doc_id", counter(s)(F.col("text")).alias("n")).select("doc_id", change(F.col("n")).alias(name))


def tier_counts(s: SparkSession, d: str, counter: Callable = _exact) -> DataFrame:
    """Flagship: clean the files, count tokens, sort into length tiers."""
    n = counter(s)(markdown.clean(F.col("content")))
    rows = table(s, d, "md_files").select(n.alias("n")).select("n", tokens.tier(F.col("n")).alias("tier"))
    return rows.where("n is not null").groupBy("tier").agg(F.count("*").alias("files"), F.sum("n").alias("n_tokens"))


def embed_plan(s: SparkSession, d: str, counter: Callable = _exact) -> DataFrame:
    files = table(s, d, "md_files").select("file_id", "content", cache.checksum(F.col("content")).alias("checksum"))
    known = cache.hits(files, table(s, d, "embedding_cache"))
    n = counter(s)(markdown.prepare(F.col("content")))
    return known.where("content is not null").select("file_id", "checksum", n.alias("n_tokens"), "cached").withColumn(
        "action", tokens.embed_action(F.col("cached"), F.col("n_tokens"))
    )


def cache_lookup(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "md_files").select(cache.checksum(F.col("content")).alias("checksum")).where("checksum is not null").distinct()
    return cache.hits(keys, table(s, d, "embedding_cache"))


def cache_upsert(s: SparkSession, d: str) -> DataFrame:
    """How many keys the cache has after the files that it lacks were added."""
    old = table(s, d, "embedding_cache").where("checksum is not null").select("checksum", F.lit(False).alias("added")).distinct()
    new = table(s, d, "md_files").select(cache.checksum(F.col("content")).alias("checksum"), F.lit(True).alias("added")).where("checksum is not null")
    return cache.upsert(old, new).groupBy("added").agg(F.count("*").alias("n"))


def sim_pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.pairs(table(s, d, "embeddings"), SIMILAR)


def group_report(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("file_"), F.col("vec_id").cast("string"), F.lit(".md")).alias("name"))
    return similarity.report(similarity.groups(sim_pairs(s, d)), names)


def knn_topk(s: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100, against all vectors."""
    v = table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    asked = v.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")
    return collection.nearest(v, asked, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance"))


def coll_add(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "eval_items").select(F.concat(F.lit("doc"), F.col("item_id").cast("string")).alias("id"), F.col("passage").alias("document"))
    new = table(s, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("document"))
    return collection.add(old, new)


def document_lines(s: SparkSession, d: str, name: str, key: list[str], text: str) -> DataFrame:
    lines = table(s, d, name).select(*key, F.posexplode(F.split(text, "\n", -1)).alias("k", "line"))
    return lines.select(*key, (F.col("k") + 1).cast("long").alias("line_no"), "line")


def line_classes(s: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    rows = table(s, d, "documents").withColumn("t", notes()).select("doc_id", F.posexplode(F.split("t", "\n", -1)).alias("k", "line"))
    return rows.select(
        "doc_id", (F.col("k") + 1).cast("long").alias("line_no"), rn.is_other_line(line).alias("other"), rn.starts_row(line).alias("starts_row"), rn.ends_table(line).alias("ends_table")
    )


def table_starts(s: SparkSession, d: str) -> DataFrame:
    """Lines of the files at which a table starts.  The next line comes from the array, so no window or shuffle is needed."""
    rows = table(s, d, "md_files").select("file_id", "ingested_at", F.split("content", "\n", -1).alias("lines"))
    rows = rows.select("file_id", "ingested_at", "lines", F.posexplode("lines").alias("k", "line"))
    rows = rows.withColumn("following", F.get("lines", F.col("k") + 1))
    return rows.where(rn.starts_table(F.col("line"), F.col("following"))).select("file_id", "ingested_at", (F.col("k") + 1).cast("long").alias("line_no"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    said, q = F.col("extracted_categories"), F.lit('"""')
    message = (
        F.when(F.col("line_id") % 4 == 0, F.concat(F.lit("Here they are:\n"), q, said, F.lit("\n"), q))
        .when(F.col("line_id") % 4 == 1, F.concat(F.lit("```"), said, F.lit("```")))
        .when(F.col("line_id") % 4 == 2, said)
        .otherwise(F.concat(q, said, q, F.lit(" or ```"), said, F.lit("```")))
    )
    return table(s, d, "category_lines").select("line_id", "filename", message.alias("message"))


def category_lines(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).where("message is not null and filename is not null").select(
        "line_id", F.explode(categories.output_lines(F.col("filename"), F.col("message"))).alias("line")
    )


_ANSWERS_SQL = """(SELECT line_id, filename, CASE line_id % 4 WHEN 0 THEN 'Here they are:' || chr(10) || '\"\"\"' || extracted_categories || chr(10) || '\"\"\"'
 WHEN 1 THEN '```' || extracted_categories || '```' WHEN 2 THEN extracted_categories ELSE '\"\"\"' || extracted_categories || '\"\"\" or ```' || extracted_categories || '```' END AS message FROM category_lines)"""


def category_distinct(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Filename: "), F.col("filename"), F.lit(" | "), F.col("extracted_categories"), F.lit("\n"))
    found = categories.distinct_categories(text)
    return table(s, d, "category_lines").where("filename is not null and extracted_categories is not null").select(
        "line_id", F.array_join(found, ", ").alias("categories"), F.size(found).cast("long").alias("n")
    )


def chat_messages(s: SparkSession, d: str, counter: Callable = _exact) -> DataFrame:
    prepared = markdown.prepare(F.col("content"))
    rows = table(s, d, "md_files").where("content is not null").select("file_id", prepared.alias("p"))
    rows = rows.withColumn("n", counter(s)(F.col("p"))).withColumn("model", tokens.chat_model(F.col("n")))
    rows = rows.withColumn("messages", categories.messages(F.when(F.col("file_id") % 2 == 0, categories.SYSTEM).otherwise(""), categories.user_message(F.col("p"))))
    return rows.select(
        "file_id", "model", F.size("messages").cast("long").alias("n_messages"), F.col("messages")[0]["role"].alias("first_role"), F.element_at("messages", -1)["content"].alias("user")
    )


_PREPARED = _chain(_ATTACH, _TRAIL, _BREAKS, _IMAGES, _STRIP)


def conv_history(s: SparkSession, d: str) -> DataFrame:
    """The answers about a file in the order in which they were logged, as a history of messages."""
    rows = table(s, d, "category_lines").where("file_id is not null")
    turn = F.struct("logged_at", "line_id", F.concat(F.coalesce("model", F.lit("?")), F.lit(": "), F.coalesce("extracted_categories", F.lit(""))).alias("said"))
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy("file_id").agg(ordered.alias("turns")).select(
        "file_id", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda x: x["said"]), "\n").alias("history")
    )


def html_footer(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "html_pages").select("page_id", html.footer_removed(F.col("html_content")).alias("page"))


def html_to_md(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "html_pages").select("page_id", html.markdown(F.col("html_content")).alias("markdown"))
    n = tokens.estimated(F.col("markdown"))
    return pages.select("page_id", "markdown", n.alias("n_tokens"), tokens.tier(n).alias("tier"))


def nlp_stem(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", nlp.stems(nlp.tokens(F.col("text"))).alias("stems"))


def stream_events(s: SparkSession, d: str) -> DataFrame:
    """The events read as a stream of files to its end and counted by hour: every event of the table that has a time."""
    file = f"{d}/events.parquet"
    schema = s.read.parquet(file).schema
    fixed = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts" else f.dataType) for f in schema.fields])
    place = f"{shared_dir(s)}/quillmere/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(fixed).format("parquet").load(file + "*")  # a pattern: the table may be one file or a folder
    return run_whole(event_counts(stream), place + "/out", place + "/state")


def precision_at_5(s: SparkSession, d: str) -> DataFrame:
    """How many of the five nearest carry the query's own label, and which share of that label they are."""
    v = table(s, d, "embeddings").select("vec_id", "label")
    asked = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(v, "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("id"))
    points = table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    of = points.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")
    # six, as a vector may be its own nearest
    six = collection.nearest(points, of, 6).where("id <> query_id")
    near = six.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 5")
    return extensions.precision_recall(near, relevant, 5).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = table
    return {
        "tier_counts": tier_counts,
        "md_above_header": _md(markdown.from_first_header),
        "md_attachments": _md(markdown.without_attachments),
        "md_trailing_ws": _md(markdown.without_trailing_blanks),
        "md_fence": _md(markdown.fenced),
        "md_breaks": _md(markdown.fewer_breaks),
        "md_clean": _md(markdown.clean),
        "md_preprocess": _md(markdown.prepare),
        "doc_checksum": _doc("checksum", lambda: cache.checksum(F.col("text"))),
        "doc_tokens": _counted("n_tokens", lambda n: n, _exact),
        "doc_tier": _counted("tier", tokens.tier, _exact),
        "route_model": _counted("model", tokens.chat_model, _exact),
        # by the counter without vocabulary, which SQL has too
        "tier_counts_estimated": lambda s, d: tier_counts(s, d, _estimated),
        "doc_tokens_estimated": _counted("n_tokens", lambda n: n, _estimated),
        "doc_tier_estimated": _counted("tier", tokens.tier, _estimated),
        "route_model_estimated": _counted("model", tokens.chat_model, _estimated),
        "embed_plan_estimated": lambda s, d: embed_plan(s, d, _estimated),
        "chat_messages_estimated": lambda s, d: chat_messages(s, d, _estimated),
        "embed_plan": embed_plan,
        "cache_lookup": cache_lookup,
        "cache_upsert": cache_upsert,
        "vec_normalize": lambda s, d: q(s, d, "embeddings").select(
            "vec_id", F.transform(vectors.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit")
        ),
        "sim_pairs": lambda s, d: sim_pairs(s, d).withColumn("cosine", F.round("cosine", 6)),
        "sim_groups": lambda s, d: similarity.groups(sim_pairs(s, d)),
        "group_report": group_report,
        "knn_topk": knn_topk,
        "coll_add": coll_add,
        "rn_task_type": _note("task_type", rn.task_type),
        "rn_priority": _note("priority", rn.priority),
        "rn_spacing": _note("spaced", rn.one_blank),
        "rn_issue_counter": _note("result", rn.issue_counter),
        "rn_key_links": _note("result", lambda t: rn.key_links(t, COMPANY)),
        "rn_rows": _note("result", rn.single_lines),
        "rn_full": _note("result", lambda t: rn.rewrite(t, COMPANY)),
        "rn_dispatch": _note("result", lambda t: rn.dispatch(t, F.col("content_type"), COMPANY)),
        "rn_transform": _note("result", lambda t: rn.transformed(t, COMPANY)),
        "line_classes": line_classes,
        "table_starts": table_starts,
        "category_lines": category_lines,
        "category_distinct": category_distinct,
        "chat_messages": chat_messages,
        "conv_history": conv_history,
        "html_footer": html_footer,
        "html_to_md": html_to_md,
        "nlp_tokens": _doc("tokens", lambda: nlp.tokens(F.col("text"))),
        "nlp_stopwords": _doc("tokens", lambda: nlp.without_stop_words(nlp.tokens(F.col("text")))),
        "nlp_bow": lambda s, d: nlp.bag_of_words(q(s, d, "documents")),
        "nlp_stem": nlp_stem,
        "nlp_lda": lambda s, d: nlp.topics(q(s, d, "documents")),
        "ext_chunks": lambda s, d: extensions.chunks(q(s, d, "documents"), 500, 50),
        "ext_sections": lambda s, d: q(s, d, "md_files").select("file_id", F.posexplode(extensions.header_sections(F.col("content"))).alias("section_no", "section")),
        "ext_precision": precision_at_5,
        "stream_events": stream_events,
    }


_TOKENS_SQL = r"list_filter(string_split_regex(lower(text), '[ \t\r\n\f]+'), lambda x: x <> '')"
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in nlp.STOP_WORDS)
_PAIRS_SQL = f"""(SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
 WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > {SIMILAR})"""
_KNN_SQL = """(SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS wanted, v.label AS label,
 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank
 FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "tier_counts_estimated": f"""WITH n AS (SELECT CAST(ceil(length({_chain(_ABOVE, _ATTACH, _TRAIL, _FENCE, _BREAKS, _STRIP)}) / 4.0) AS BIGINT) AS n FROM md_files WHERE content IS NOT NULL)
            SELECT CASE WHEN n <= 3500 THEN 'short' WHEN n < 15000 THEN 'medium' ELSE 'long' END AS tier, count(*) AS files, CAST(sum(n) AS BIGINT) AS n_tokens FROM n GROUP BY 1""",
        "md_above_header": _md_sql(_ABOVE),
        "md_attachments": _md_sql(_ATTACH),
        "md_trailing_ws": _md_sql(_TRAIL),
        "md_fence": _md_sql(_FENCE),
        "md_breaks": _md_sql(_BREAKS),
        "md_clean": _md_sql(_ABOVE, _ATTACH, _TRAIL, _FENCE, _BREAKS, _STRIP),
        "md_preprocess": _md_sql(_ATTACH, _TRAIL, _BREAKS, _IMAGES, _STRIP),
        "doc_checksum": "SELECT doc_id, sha256(text) AS checksum FROM documents",
        "doc_tokens_estimated": f"SELECT doc_id, {_N} AS n_tokens FROM documents",
        "doc_tier_estimated": f"SELECT doc_id, {_TIER} AS tier FROM documents",
        "route_model_estimated": f"SELECT doc_id, {_MODEL} AS model FROM documents",
        "embed_plan_estimated": f"""WITH f AS (SELECT file_id, sha256(content) AS checksum, CAST(ceil(length({_PREPARED}) / 4.0) AS BIGINT) AS n_tokens FROM md_files WHERE content IS NOT NULL),
            g AS (SELECT *, checksum IN (SELECT checksum FROM embedding_cache WHERE checksum IS NOT NULL) AS cached FROM f)
            SELECT *, CASE WHEN cached THEN 'reuse' WHEN n_tokens <= 8000 THEN 'embed' ELSE 'skip' END AS action FROM g""",
        "cache_lookup": """SELECT DISTINCT sha256(content) AS checksum, sha256(content) IN (SELECT checksum FROM embedding_cache WHERE checksum IS NOT NULL) AS cached
            FROM md_files WHERE content IS NOT NULL""",
        "cache_upsert": """WITH o AS (SELECT DISTINCT checksum FROM embedding_cache WHERE checksum IS NOT NULL), n AS (SELECT DISTINCT sha256(content) AS checksum FROM md_files WHERE content IS NOT NULL)
            SELECT added, count(*) AS n FROM (SELECT false AS added FROM o UNION ALL SELECT true FROM n WHERE checksum NOT IN (SELECT checksum FROM o)) GROUP BY 1""",
        "vec_normalize": """SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / n, 6)) AS unit
            FROM (SELECT vec_id, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""",
        "sim_pairs": f"SELECT vec_a, vec_b, round(cosine, 6) AS cosine FROM {_PAIRS_SQL}",
        "sim_groups": f"SELECT vec_a AS vec_id, list(vec_b ORDER BY vec_b) AS similar FROM {_PAIRS_SQL} GROUP BY 1",
        "group_report": f"""SELECT vec_a AS vec_id, 'File: file_' || vec_a || '.md is similar to:' || chr(10) || string_agg(' - file_' || vec_b || '.md', chr(10) ORDER BY vec_b) AS report
            FROM {_PAIRS_SQL} GROUP BY 1""",
        "knn_topk": f"SELECT query_id, rank, id, round(distance, 6) AS distance FROM {_KNN_SQL} WHERE rank <= 5",
        "coll_add": """WITH o AS (SELECT 'doc' || item_id AS id, passage AS document FROM eval_items)
            SELECT * FROM o UNION ALL SELECT 'doc' || doc_id, min(text) FROM documents WHERE 'doc' || doc_id NOT IN (SELECT id FROM o) GROUP BY 1""",
        "rn_task_type": rf"SELECT doc_id, nullif(regexp_extract(t, '!\[(.*?)\]', 1), '') AS task_type FROM {_NOTES}",
        "rn_priority": rf"""SELECT doc_id, upper(p[1]) || lower(p[2:]) AS priority FROM (SELECT doc_id, nullif(regexp_extract(t, 'icons/priorities/(.*?).svg', 1), '') AS p FROM {_NOTES})""",
        "rn_spacing": rf"SELECT doc_id, regexp_replace(t, '{_WS}{{2,}}', ' ', 'g') AS spaced FROM {_NOTES}",
        "rn_issue_counter": rf"SELECT doc_id, regexp_replace(t, '\[{_WS}*(\d+{_WS}*issue[s]?){_WS}*\]\(https://[^)]+\)', '\1', 'g') AS result FROM {_NOTES}",
        "rn_key_links": f"SELECT doc_id, {_KEYS_SQL} AS result FROM {_NOTES}",
        "rn_rows": f"SELECT doc_id, {_ROWS_SQL} AS result FROM documents",
        "rn_full": f"SELECT doc_id, {_FULL_SQL} AS result FROM documents",
        "rn_dispatch": f"SELECT doc_id, CASE WHEN content_type = 'release_notes' THEN {_FULL_SQL} ELSE {_NOTES_SQL} END AS result FROM documents",
        "line_classes": rf"""SELECT doc_id, line_no, starts_with(line, '## ') OR contains(line, '![](') OR contains(line, 'Key | Summary | T |') AS other,
            regexp_matches(line, '\A\[EW-\d+\]') AS starts_row, {_STRIP % "line"} = '' OR NOT contains(line, '|') AS ends_table
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM {_NOTES})""",
        "table_starts": """SELECT file_id, ingested_at, line_no FROM (SELECT file_id, ingested_at, unnest(l) AS line, unnest(l[2:] || [NULL]) AS following, unnest(range(1, len(l) + 1)) AS line_no
            FROM (SELECT file_id, ingested_at, string_split(content, chr(10)) AS l FROM md_files WHERE content IS NOT NULL))
            WHERE contains(line, '|') AND (contains(following, '---') OR contains(following, '|'))""",
        "category_lines": rf"""WITH m AS (SELECT line_id, filename, regexp_extract_all(message, '(?s)\"\"\".*?\"\"\"|```.*?```') AS f FROM {_ANSWERS_SQL} WHERE message IS NOT NULL AND filename IS NOT NULL)
            SELECT line_id, 'Filename: ' || filename || ' | ' || CASE WHEN len(f) = 0 THEN 'No categories found.' ELSE {_STRIP % "p[4:len(p)-3]"} END AS line
            FROM (SELECT line_id, filename, f, unnest(CASE WHEN len(f) = 0 THEN [''] ELSE f END) AS p FROM m)""",
        "category_distinct": r"""WITH t AS (SELECT line_id, list_sort(list_distinct(string_split(array_to_string(
            regexp_extract_all('Filename: ' || filename || ' | ' || extracted_categories || chr(10), '\| Categories: (.+?)\n', 1), ', '), ', '))) AS c
            FROM category_lines WHERE filename IS NOT NULL AND extracted_categories IS NOT NULL)
            SELECT line_id, array_to_string(c, ', ') AS categories, CAST(len(c) AS BIGINT) AS n FROM t""",
        "chat_messages_estimated": f"""WITH p AS (SELECT file_id, {_PREPARED} AS p FROM md_files WHERE content IS NOT NULL), n AS (SELECT *, CAST(ceil(length(p) / 4.0) AS BIGINT) AS n FROM p)
            SELECT file_id, CASE WHEN n <= 3500 THEN 'gpt-3.5-turbo-1106' WHEN n < 15000 THEN 'gpt-3.5-turbo-16k' END AS model, CAST(CASE WHEN file_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_messages,
            CASE WHEN file_id % 2 = 0 THEN 'system' ELSE 'user' END AS first_role,
            'Name the categories of the following document. Answer as \"\"\"Categories: first, second\"\"\".' || chr(10) || '```markdown' || chr(10) || p || chr(10) || '```' AS "user" FROM n""",
        "conv_history": """SELECT file_id, count(*) AS n, string_agg(coalesce(model, '?') || ': ' || coalesce(extracted_categories, ''), chr(10) ORDER BY logged_at NULLS FIRST, line_id) AS history
            FROM category_lines WHERE file_id IS NOT NULL GROUP BY 1""",
        "nlp_tokens": f"SELECT doc_id, {_TOKENS_SQL} AS tokens FROM documents",
        "nlp_stopwords": f"SELECT doc_id, list_filter({_TOKENS_SQL}, lambda x: x NOT IN ({_STOP_SQL})) AS tokens FROM documents",
        "nlp_bow": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS token FROM documents) GROUP BY ALL",
        "ext_chunks": """SELECT doc_id, k + 1 AS chunk_no, substring(text, CAST(k * 450 + 1 AS BIGINT), 500) AS chunk
            FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 50, 1) / 450.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)""",
        "ext_precision": f"""WITH near AS (SELECT query_id, count(*) FILTER (wanted = label) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM {_KNN_SQL} WHERE id <> query_id) WHERE place <= 5 GROUP BY 1),
            want AS (SELECT q.vec_id AS query_id, count(*) AS want FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1)
            SELECT query_id, round(coalesce(hits, 0) / 5.0, 6) AS precision, round(coalesce(hits, 0) / want, 6) AS recall FROM want LEFT JOIN near USING (query_id)""",
    }
