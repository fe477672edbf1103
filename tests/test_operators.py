import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere import sources
from quillmere.functions import categories, vectors
from quillmere.operators import cache, collection, embed, extensions, html, nlp, similarity
from quillmere.streaming import cleaned_stream, run_once


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_footer():
    page = '<div><div id="footer" role="contentinfo"><div>a</div>b</div>c</div><div id="footer" role="contentinfo">d</div>'
    assert html.remove_footer(page) == '<div>c</div><div id="footer" role="contentinfo">d</div>'
    assert html.remove_footer("<footer>x</footer>") == "<footer>x</footer>"
    assert html.remove_footer("<div id=footer role=contentinfo>open") == ""


def test_markdown_of_html():
    page = "<html><head><title>t</title></head><body><h2>A &amp; B</h2><p>x <b>bold</b> <a href='u'>l</a></p><ul><li>1<li>2</ul><pre>a\n  b</pre><script>if (a < b) '</p>'</script></body>"
    assert html.to_markdown(page) == "## A & B\n\nx **bold** [l](u)\n\n  * 1\n  * 2\n\n```\na\n  b\n```\n"
    assert html.to_markdown("") == ""
    assert "[" not in html.to_markdown("<p><a href='u'>l</a><img src='s'></p>", html.Options(True, True))


def test_pairs_in_blocks_equal_the_theta_join(spark):
    rng = np.random.default_rng(0)
    data = [(k, [float(v) for v in rng.normal(size=8)]) for k in range(60)] + [(60, [0.0] * 8), (61, None)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    plain = rows(similarity.pairs_by_expression(v.where("embedding is not null"), 0.3).select("vec_a", "vec_b"), "vec_a", "vec_b")
    for size in (1000, 13):
        assert rows(similarity.pairs(v, 0.3, size).select("vec_a", "vec_b"), "vec_a", "vec_b") == plain
    assert similarity.pairs(v.limit(0), 0.3).count() == 0
    grouped = similarity.groups(spark.createDataFrame([(1, 3), (1, 2)], "vec_a long, vec_b long"))
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "vec_id long, name string")
    assert rows(similarity.report(grouped, names)) == [(1, "File: a is similar to:\n - b\n - c")]


def test_unit(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k long, v array<double>")
    assert rows(v.select(vectors.unit(F.col("v"))), "k") == [([0.6, 0.8],), ([0.0, 0.0],)]
    assert rows(v.select(vectors.cosine(F.col("v"), F.col("v"))), "k") == [(1.0,), (0.0,)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "id long, embedding array<double>")
    got = rows(collection.nearest(v, v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding"), 4).select("query_id", "rank", "id"), "query_id", "rank")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = [(q, k + 1, int(i)) for q in range(0, 50, 10) for k, i in enumerate(np.argsort(1 - u @ u[q], kind="stable")[:4])]
    assert got == want
    tied = spark.createDataFrame([(9, [1.0, 0.0]), (3, [2.0, 0.0]), (5, [3.0, 0.0])], "id long, embedding array<double>")
    assert [r[2] for r in rows(collection.nearest(tied, tied.where("id = 9").select(F.col("id").alias("query_id"), "embedding"), 2).select("query_id", "rank", "id"), "rank")] == [3, 5]


def test_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    c = collection.Collection(spark, path)
    c.add_documents(spark.createDataFrame([("red apple",), ("green pear",)], "document string").coalesce(1))
    c.add_documents(spark.createDataFrame([("blue sky",)], "document string"))
    c.add_documents(spark.createDataFrame([("doc1", "other"), ("x", "cold water")], "id string, document string"))
    assert {r["id"]: r["document"] for r in c.table().collect()} == {"doc1": "red apple", "doc2": "green pear", "doc3": "blue sky", "x": "cold water"}
    got = c.query(spark.createDataFrame([(1, "a blue sky")], "query_id long, text string"), 2)
    assert rows(got.where("rank = 1").select("id", "document")) == [("doc3", "blue sky")]
    with pytest.raises(ValueError):
        collection.Collection(spark, path, embed.HashingEmbedder(8))


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.load(spark, path).count() == 0
    one = spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "checksum string, embedding array<double>")
    cache.save(cache.upsert(cache.load(spark, path), one), path)
    two = spark.createDataFrame([("a", [9.0]), ("b", [2.0])], "checksum string, embedding array<double>")
    cache.save(cache.upsert(cache.load(spark, path), two), path + "2")
    assert rows(cache.load(spark, path + "2"), "checksum") == [("a", [1.0]), ("b", [2.0])]
    (tmp_path / "c.json").write_text(json.dumps({"k": [1.0, 2.0]}))
    assert rows(cache.load_json(spark, str(tmp_path / "c.json"))) == [("k", [1.0, 2.0])]
    docs = spark.createDataFrame([("a",), ("z",), ("z",)], "checksum string")
    assert cache.misses(docs, one).count() == 1 and rows(cache.hits(docs, one).where("cached"))[0][0] == "a"


def test_categories(spark):
    text = 'a """Categories: x\n""" b ```y``` """"""'
    df = spark.createDataFrame([("f.md", text), ("g.md", "none")], "n string, m string").coalesce(1)
    assert [r[0] for r in df.select(categories.output_lines(F.col("n"), F.col("m"))).collect()] == [
        ["Filename: f.md | Categories: x", "Filename: f.md | y", "Filename: f.md | "],
        ["Filename: g.md | No categories found."],
    ]
    file = spark.createDataFrame([("F | Categories: b, a\nF | Categories: a, c\nF | Categories: lost",), ("",)], "t string").coalesce(1)
    assert [r[0] for r in file.select(categories.distinct_categories(F.col("t"))).collect()] == [["a", "b", "c"], [""]]
    user = spark.createDataFrame([("", "hi"), ("s", "ho")], "s string, u string").coalesce(1)
    assert [r[0] for r in user.select(F.size(categories.messages(F.col("s"), F.col("u")))).collect()] == [1, 2]


def test_stems():
    # worked examples of the paper
    for word, want in {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
        "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control",
    }.items():
        assert nlp.stem(word) == want, word


def test_topics_from_all_documents_and_terms(spark):
    # each heavy term stands in one document only
    texts = [" ".join([f"heavy{k}"] * 400 + [f"w{k}x{j}" for j in range(900)]) for k in range(6)] + [None, ""]
    got = rows(nlp.topics(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert len(got) == 30 and {t for t, _, _ in got} == {0, 1, 2}
    assert {f"heavy{k}" for k in range(6)} <= {term for _, term, _ in got}


def test_extensions(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(extensions.chunks(d, 4, 1), "doc_id", "chunk_no") == [(1, 1, "abcd"), (1, 2, "defg"), (1, 3, "ghij")]
    t = spark.createDataFrame([("a\n# B\nc\n## D",)], "t string")
    assert t.select(extensions.header_sections(F.col("t"))).first()[0] == ["a\n", "# B\nc\n", "## D"]


def test_folders_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A")
    (tmp_path / "in" / "b.txt").write_text("no")
    (tmp_path / "in" / "sub" / "c.md").write_text("no")
    docs = sources.read_markdown(spark, str(tmp_path / "in"))
    assert rows(docs.select("name", "text")) == [("a.md", "# A")]
    sources.write_by_tier(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("tier = 'short'").count() == 1
    sources.write_category_lines(spark.createDataFrame([("f", "```x```")], "filename string, message string"), str(tmp_path / "lines"))
    assert rows(sources.read_category_file(spark, str(tmp_path / "lines") + "/part*").select(F.trim("text"))) [0][0].startswith("Filename: f | x")


def test_stream_counts_every_event(spark, tmp_path):
    import datetime as d

    from quillmere import queries as Q

    day = d.datetime(2024, 1, 1)
    # open windows at the end, and in a later file events far behind the watermark and events without time
    first = [(day + d.timedelta(minutes=10 * k), "ab"[k % 2], float(k)) for k in range(60)]
    late = [(day - d.timedelta(days=3), "a", 1.0), (None, "b", 2.0)]
    for part in (first, late):
        spark.createDataFrame(part, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    read = spark.read.parquet(str(tmp_path / "events.parquet"))
    want = read.where("ts is not null").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    got = Q.stream_events(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 21


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("intro\n# A",)], "text string").write.parquet(str(source))
    stream = lambda: cleaned_stream(spark.readStream.schema("text string").parquet(str(source)))
    assert rows(run_once(stream(), str(tmp_path / "out"), str(tmp_path / "state")).select("clean", "tier")) == [("# A", "short")]
    spark.createDataFrame([("# B",)], "text string").write.mode("append").parquet(str(source))
    assert run_once(stream(), str(tmp_path / "out"), str(tmp_path / "state")).count() == 2


def test_jobs(spark, tmp_path):
    from quillmere import cli

    folder = tmp_path / "md"
    folder.mkdir()
    for name, text in {"a": "# T\nred apples and green pears", "b": "# T\ngreen pears and red apples", "c": "# U\nsomething else entirely"}.items():
        (folder / f"{name}.md").write_text(text)
    got = rows(cli.group(spark, str(folder), str(tmp_path / "cache")).select("report"))
    assert len(got) == 1 and sorted(got[0][0].replace("File: ", "").replace(" is similar to:\n - ", " ").split()) == ["a.md", "b.md"]
    assert cli.group(spark, str(folder), str(tmp_path / "cache")).count() == 1
    cli.tag(spark, str(folder), str(tmp_path / "tags"))
    assert spark.read.text(str(tmp_path / "tags")).count() == 3
    (folder / "p.html").write_text('<h1>A</h1><div id="footer" role="contentinfo">x</div>')
    cli.convert(spark, str(folder), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("p.md", "# A\n", "short")]
