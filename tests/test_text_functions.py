import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions import markdown, tokens
from quillmere.functions import release_notes as rn
from quillmere.functions.text import strip


def apply(spark, change, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").repartition(1)
    return [r["x"] for r in rows.select("k", change(F.col("t")).alias("x")).orderBy("k").collect()]


def test_header(spark):
    given_ = ["intro\n\n# A\nb", "no header", "", None, "\U0001f600 x\n## B", "#tag first", "a\n  \n  # C"]
    assert apply(spark, markdown.from_first_header, given_) == ["\n# A\nb", "no header", "", None, "## B", "#tag first", "  \n  # C"]


def test_attachments(spark):
    given_ = ["# A\nx ![p](attachments/1.png) y\nz", "# A\n## Attachments:\n* f", "## Attachments: no line end before", None]
    assert apply(spark, markdown.without_attachments, given_) == ["# A\n\nz", "# A", "## Attachments: no line end before", None]


def test_fence(spark):
    given_ = ["    code\nplain", "    a\n\n    b", "    a\n\n    b\nx", "x\n    last line without end"]
    want = ["```\n    code\n```\nplain", "```\n    a\n```\n\n    b", "```\n    a\n\n    b\n```\nx", "x\n    last line without end"]
    assert apply(spark, markdown.fenced, given_) == want


def test_breaks_blanks_and_clean(spark):
    assert apply(spark, markdown.fewer_breaks, ["a\n\n\n\nb", "a\n\nb", "a\n \n\t\n b"]) == ["a\n\nb", "a\n\nb", "a\n\nb"]
    assert apply(spark, markdown.without_trailing_blanks, ["a \t\nb\r\n c  "]) == ["a\nb\r\n c"]
    assert apply(spark, markdown.clean, ["intro\n# H  \n\n\n\ntext\n## Attachments:\nx", None]) == ["# H\n\ntext", None]
    assert apply(spark, markdown.prepare, ["# T\n![a](b) and ![c](d) e\n"]) == ["# T\n e"]


def test_long_texts_do_not_recurse(spark):
    many = ["\n" * 200_000, "    x\n" * 50_000]
    assert apply(spark, markdown.fewer_breaks, many)[0] == "\n\n"
    assert len(apply(spark, markdown.fenced, many)[1]) == 50_000 * 6 + 8


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\r#a  é\U0001f600`", max_size=30), min_size=20, max_size=40))
def test_rules_against_plain_python(spark, texts):
    assert apply(spark, strip, texts) == [t.strip() for t in texts]
    assert apply(spark, markdown.without_trailing_blanks, texts) == [re.sub(r"[ \t]+$", "", t, flags=re.M) for t in texts]
    once = apply(spark, markdown.fewer_breaks, texts)
    assert once == [re.sub(r"(\n[ \t]*){3,}", "\n\n", t) for t in texts]
    assert apply(spark, markdown.fewer_breaks, once) == once


def test_tiers(spark):
    n = spark.createDataFrame([(3500,), (3501,), (14999,), (15000,), (None,)], "n long")
    assert [r[0] for r in n.select(tokens.tier(F.col("n"))).collect()] == ["short", "medium", "medium", "long", None]
    assert [r[0] for r in n.select(tokens.chat_model(F.col("n"))).collect()] == [tokens.SHORT_MODEL, tokens.MEDIUM_MODEL, tokens.MEDIUM_MODEL, None, None]
    assert apply(spark, tokens.estimated, ["", "a", "abcd", "abcde", None]) == [0, 1, 1, 2, None]


B = "https://acme.atlassian.net/browse/"


def test_release_notes(spark):
    text = (
        f"## Release\n[ 2 issues ](https://x.y/q)\n[EW-12]({B}EW-12) | [Fix login]({B}EW-12) | [![Bug](https://a/i.png)]({B}EW-12) | "
        "![Major](https://a/icons/priorities/major.svg) | \nFixed\n[EW-13] | Bare\nFixed"
    )
    want = f"## Release\n2 issues\n[EW-12]({B}EW-12) | Fix login | Bug | Major | Fixed\n[EW-13]({B}EW-13) | Bare Fixed"
    assert apply(spark, lambda t: rn.rewrite(t, "acme"), [text, None, ""]) == [want, None, ""]
    assert apply(spark, rn.priority, ["![x](icons/priorities/very high.svg)", "none"]) == ["Very high", None]
    assert apply(spark, rn.task_type, ["[![New $1 \\ thing](a)](b)", "![]()"]) == ["New $1 \\ thing", None]
    assert apply(spark, rn.row, ["[![A $1 \\ b](x)](y) | z"]) == ["A $1 \\ b | z"]


def line_machine(text, company="acme"):
    """The line machine as a loop, to compare with."""

    def row(entry):
        entry = entry.strip()
        kind = re.search(r"!\[(.*?)\]", entry)
        if kind and kind[1]:
            entry = re.sub(r"\[!\[.*?\]\(.*?\)\]\(.*?\)", lambda m: kind[1], entry)
        entry = re.sub(r"\[\s?(?!EW-)(.*?)\s?\]\(https://.*?\)", r"\1", entry)
        return re.sub(r"\s{2,}", " ", entry)

    def link(line):
        key = re.search(r"\[(EW-\d+)\]", line)
        full = key and f"[{key[1]}](https://{company}.atlassian.net/browse/{key[1]})"
        return line if not key or full in line else line.replace(f"[{key[1]}]", full)

    out, held = [], []
    for line in text.split("\n"):
        other = line.startswith("## ") or "![](" in line or rn.HEADER in line
        if other or re.match(r"\[EW-\d+\]", line) and held:
            out += [row("".join(held)), link(line.strip())]
            held = []
        else:
            held.append(line)
    return "\n".join([*out, row("".join(held))])


def test_line_machine(spark):
    texts = ["a\nb\n## c\n[EW-1] d\n e\n[EW-2] f", "[EW-1] a\n[EW-2] b\nc", "", "\n\n## x", "Key | Summary | T |\n[EW-3] [s](https://q) y"]
    assert apply(spark, lambda t: rn.transformed(t, "acme"), texts) == [line_machine(t) for t in texts]


def test_exact_counter(spark):
    import pathlib

    import pytest

    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not pathlib.Path(ranks).exists():
        pytest.skip("no vocabulary")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    count = tokens.exact(spark, ranks, pattern)
    assert apply(spark, count, ["Hello world", "", None, "<|endoftext|>"]) == [2, 0, None, 7]


def test_queries_count_like_the_library(spark):
    import base64
    import pathlib

    import pytest

    from quillmere import queries as Q

    if not pathlib.Path(tokens.RANKS).exists() or not pathlib.Path("/root/testdata/sf0.001").exists():
        pytest.skip("no vocabulary or tables")
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.RANKS, "rb"))}
    library = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=table, special_tokens={})
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {k: None if t is None else len(library.encode_ordinary(t)) for k, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in Q.queries()["doc_tokens"](spark, sf).collect()} == want
    tier = lambda n: None if n is None else "short" if n <= 3500 else "medium" if n < 15000 else "long"
    assert {r["doc_id"]: r["tier"] for r in Q.queries()["doc_tier"](spark, sf).collect()} == {k: tier(n) for k, n in want.items()}
    cleaned = [r["result"] for r in Q.queries()["md_clean"](spark, sf).where("result is not null").collect()]
    sums = {}
    for t in cleaned:
        n = len(library.encode_ordinary(t))
        files, total = sums.get(tier(n), (0, 0))
        sums[tier(n)] = (files + 1, total + n)
    assert {r["tier"]: (r["files"], r["n_tokens"]) for r in Q.queries()["tier_counts"](spark, sf).collect()} == sums
