import base64
import itertools
import random
import re
import time

import numpy as np
import pytest

from quillmere.llm import clean_markup, language, leaks, main_body, markup, subjects, tokenize
from quillmere.llm.html_tokens import read

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 5) for i, t, lang in rows], "doc_id long, text string, lang string, label string, seg_no int")


# ---- tokenizer ----


@pytest.fixture(scope="module")
def automaton():
    return tokenize.Automaton(open(tokenize.VOCABULARY, "rb").read())


def test_encoding_equals_the_library(automaton):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(0)
    texts = ["", " ", "\n\n \t", "it's <|endoftext|>", "é ﬁ \U0001f468‍\U0001f469‍\U0001f467", "a" * 3000, "日本語テキスト", "x\r\ny"]
    for alphabet in ("ab", "aA ", "the ", "=-", "esrti", "".join(map(chr, range(32, 700)))):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(300)]
    for t in texts:
        ids = automaton.encode(t)
        assert ids == library.encode_ordinary(t), repr(t)
        assert automaton.decode(ids) == t


def test_only_paths_are_encodings(automaton):
    # an arc exists exactly if the two tokens side by side are their own encoding
    r = random.Random(1)
    tokens = [t for t, label in automaton.label.items() if len(label) < 6]
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert automaton.arc(a, b) == (automaton.word(automaton.label[a] + automaton.label[b]) == [a, b])


def test_encode_on_spark(spark):
    rows = [(1, None, None), (2, "", None), (3, "Hello world", None), (3, "Hello world", None), (4, "a b " * 50_000, None)]
    got = [(r["doc_id"], r["ids"]) for r in tokenize.encode(documents(spark, rows)).collect()]
    assert sorted((i, x[:3]) for i, x in got)[:4] == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert tokenize.round_trip(documents(spark, rows)).where("not same").count() == 0
    assert tokenize.encode(documents(spark, [])).count() == 0


# ---- leaks ----

ITEM = (
    "Seven tired plumbers count the silver spoons of Castle Nine before breakfast. Nobody in Port Azure remembers the colour of the "
    "third umbrella. The lighthouse keeper buys 52 candles and hides every one of them under a wooden boat near the old mill."
)


def leak_rows():
    w = ITEM.split()
    changed = " ".join("zebra" if k % 9 == 4 else x for k, x in enumerate(w))
    inserted = " ".join(w[:15]) + ". A short remark that is not part of it. " + " ".join(w[15:])
    return [
        (1, "Before. " + ITEM + " After.", True),
        (2, ITEM.upper().replace(",", ""), True),
        (3, "# x\n> " + ITEM[:60].replace(" spoons", " spo-\nons") + "\n> " + ITEM[60:].replace(" ", "\n", 5), True),
        (4, "start " + changed + " end", True),
        (5, "start " + inserted, True),
        (6, " ".join(w[: len(w) // 2 + 2]), True),
        (7, " ".join(w[: len(w) // 3]), False),
        (8, " ".join(reversed(w)), False),
        (9, " filler words without end ".join(w), False),
        (10, None, False),
        (11, "", False),
        (12, "<p>" + ITEM.replace("silver", "<b>silver</b>").replace("third", "*third*") + "</p>", True),
    ]


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM, "s"), (2, None, "s"), (3, "too short", "s"), (4, ITEM, "s"), (None, ITEM, "s")], "item_id long, passage string, doc_id string")
    rows = leak_rows()
    docs = documents(spark, [(i, t, None) for i, t, _ in rows] + [(1, rows[0][1], None)])
    got = sorted(map(tuple, leaks.found(docs, items).collect()))
    assert got == sorted([(i, k) for i, _, leaked in rows if leaked for k in (1, 4)] + [(5, 3)])  # one of two words is half of them
    assert leaks.found(docs, items.limit(0)).count() == 0 and leaks.found(documents(spark, []), items).count() == 0


def test_common_subsequence():
    seeds = leaks.Seeds([(1, "a b c d e f g h i j")])
    known = seeds.table
    for text, n in (("a b c d e f g h i j", 10), ("j i h", 1), ("a x c x e", 3), ("q", 0)):
        assert leaks.common(seeds.bits[0], 10, [known.get(w, 0) for w in text.split()]) == n


def edited(r, w, kind):
    """An item's words, quoted in half and more, with changed words, with an insertion, or whole."""
    n = len(w)
    if kind == "half":
        m = (n + 1) // 2
        at = r.randint(0, n - m)
        return w[at : at + m]
    if kind == "changed":
        return ["zzz" if k % 4 == 3 else x for k, x in enumerate(w)]
    if kind == "inserted":
        at = r.randint(0, n)
        return w[:at] + ["one", "more", "remark"][: max(1, min(3, n // 3))] + w[at:]
    return w


@pytest.mark.parametrize("many", [False, True])
def test_leaks_of_every_length(spark, monkeypatch, many):
    r = random.Random(4)
    items = {n: [f"w{r.randint(0, 400)}" for _ in range(n)] for n in range(1, 41)}
    fill = lambda n: [f"f{r.randint(0, 99)}" for _ in range(n)]
    docs, planted = [], set()
    for n, w in items.items():
        for kind in ("half", "changed", "inserted", "whole"):
            docs.append((len(docs), " ".join(fill(30) + edited(r, w, kind) + fill(30)), None))
            planted.add((len(docs) - 1, n))
    if many:
        monkeypatch.setattr(leaks, "FEW_WORDS", 0)
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, passage string")
    got = {tuple(x) for x in leaks.found(documents(spark, docs), table).collect()}
    ids = {}
    of = lambda ws: [ids.setdefault(x, len(ids) + 1) for x in ws]
    words = {i: of(t.split()) for i, t, _ in docs}

    def brute(i, n, slack):
        bits, text = leaks.bits_of(of(items[n])), words[i]
        return any(2 * leaks.common(bits, n, text[k : k + n + slack]) >= n for k in range(len(text)))

    tight = {(i, n) for i in words for n in items if brute(i, n, min(n, leaks.PLACE))}
    loose = {(i, n) for i in words for n in items if brute(i, n, 2 * leaks.PLACE + 4)}
    assert planted <= tight
    assert {x for x in tight if x[1] < leaks.SHORT} <= got <= loose  # exact for short items
    assert len(got & tight) >= 0.99 * len(tight) and len(got & planted) >= 0.99 * len(planted)


# ---- languages ----

SENTENCES = {lang: [s.strip() + "." for s in text.split(". ")] for lang, text in language.BUILT_IN.items()}


def test_languages(spark):
    rows = [(k, " ".join(s * 2), lang) for k, (lang, s) in enumerate(SENTENCES.items())]
    r = random.Random(0)
    rows += [(100 + 10 * k + n, " ".join(r.sample(s, len(s))), lang) for k, (lang, s) in enumerate(SENTENCES.items()) for n in range(5)]
    en, de = " ".join(SENTENCES["en"]), " ".join(SENTENCES["de"])
    rows += [
        (20, en, "deu"), (21, en, None), (22, en, "und"), (23, en, "en-GB"), (24, f"{de}\n\n{en[:90]}\n \n{de}", None), (25, "a=1\nb=2\n" * 30, "fr"),
        (26, None, "en"), (27, "", None), (28, "Klaar.", "en"), (29, f"{de} \"{en[:60]}\" {de}", "DE"), (30, f"```\n{en}\n```\n\n{de}", "de"), (20, en, "deu"),
    ]
    got = sorted(map(tuple, language.found(documents(spark, rows)).collect()))
    assert got == [(20, 0, "en"), (21, 0, "en"), (22, 0, "en"), (24, 0, "de"), (24, 2, "en")]
    every = language.segments(documents(spark, rows)).where("seg_no = 0").collect()
    assert {r["doc_id"]: r["lang"] for r in every if r["doc_id"] < 8} == dict(enumerate(SENTENCES))
    assert all(0 < r["confidence"] <= 1 for r in every)
    assert language.found(documents(spark, [])).count() == 0


def test_paragraph_numbers():
    assert [(n, len(w)) for n, w, _ in language.paragraphs("\n\na b\nc\n \n\n```\nx y\n\nz\n```\nd\r\n\r\ne")] == [(1, 3), (2, 0), (3, 1), (4, 1)]


# ---- pages ----


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html_content string, token string, place int")


ARTICLE = "<h1>Gate plan</h1><p>The gate of the yard opens at six and closes at nine.</p><ul><li>Key 12</li><li>Spare key 40</li></ul><pre>run --gate 7</pre><p>For it we assume \\(a + b\\) here.</p>"


def page(body=ARTICLE, extra=""):
    nav = "".join(f'<li class="nav-item"><a href="/{k}">{w}</a></li>' for k, w in enumerate(("Spaces", "Home", "Help", "People")))
    return f"<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><nav><ul>{nav}</ul></nav><!-- <h1>old</h1> --><main>{body}{extra}</main><footer><p>Yard wiki, build 3</p></footer></body></html>"


def test_reader_numbers_blocks():
    nodes, blocks = read("<P>a<!-- <p> --><LI>b<script><p></script><pre>&lt;b&gt;</pre></li><h2 class='x'>c</h2>d")
    assert blocks == {1: "p", 2: "li", 3: "pre", 4: "h2"}
    assert [(n.text, n.blocks) for n in nodes] == [("a", (1,)), ("b", (2,)), ("<b>", (2, 3)), ("c", (4,)), ("d", ())]


def test_main_body(spark):
    rows = [(1, "u", page()), (2, "u", page(extra='<div class="vote"><p>Was this page helpful?</p><ul><li>Yes</li><li>No</li></ul></div>')), (3, None, None), (4, "u", ""), (None, "u", page()), (5, "u", "<p>" * 20_000), (1, "u", page())]
    got = sorted(map(tuple, main_body.found(pages(spark, rows)).collect()))
    article = [5, 6, 7, 8, 9, 10]  # after the four items of the menu
    assert got == [(p, b) for p in (1, 2) for b in article]
    text = main_body.bodies(pages(spark, rows)).where("page_id = 1").first()["main_text"]
    assert text.startswith("Gate plan") and "Spaces" not in text and "build" not in text
    assert main_body.found(pages(spark, [])).count() == 0


def test_labelled_pages_are_learned():
    right = wrong = 0
    w = main_body.weights()
    for site in main_body.SITES:
        marked = []
        for text in site:
            nodes, _ = read(main_body._KEPT.sub(lambda m: main_body._TEXT.sub(r">¤\1<", m[0]), text).replace("{{", "").replace("}}", ""), main_body.names_say)
            marks = [n.text.startswith("¤") for n in nodes]
            for n in nodes:
                n.text = n.text.lstrip("¤")
            us = main_body.units(nodes)[1]
            marked.append((us, [marks[u.first] for u in us]))
        on = [x for us, _ in marked for x in {x for u in us for x in (u.token, u.link) if x}]
        repeated = {x for x in on if main_body.is_repeated(on.count(x), len(site))}
        for us, inside in marked:
            values = w.values([w.base(u) for u in us], [u.words for u in us], *main_body.columns(us), repeated)
            for good, k in zip(inside, main_body.best_segments(values)):
                right, wrong = (right + 1, wrong) if good == k else (right, wrong + 1)
    assert wrong <= 0.02 * right


def test_best_segments_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        v = [r.randint(-6, 6) for _ in range(r.randint(0, 10))]
        cost = r.choice([0.0, 1.0, 3.0, 6.0])

        def worth(keep):
            starts = sum(k and not (i and keep[i - 1]) for i, k in enumerate(keep))
            return sum(x for x, k in zip(v, keep) if k) - cost * max(0, starts - 1)

        best = max(worth([n >> i & 1 for i in range(len(v))]) for n in range(1 << len(v)))
        assert worth(main_body.best_segments(v, cost)) == max(best, 0)
    assert main_body.best_segments([5, -20, 2, -1, 7, -20], 4) == [True, False, True, True, True, False]


def test_the_scan_decides_and_wording_does_not(spark):
    # furniture in words that no labelled page has, in boxes without names, and a line that stands flat below the article
    box = "<div><p>Zorb flim quast derra moli nanti.</p><ul><li>Flimmo</li><li>Quastel</li></ul></div>"
    text = lambda c: f"<h1>Gate {c}</h1><p>The gate of {c} opens when the guard of {c} has come.</p>{box}<p>Then {c} may enter the yard and go to the hall.</p>"
    rows = [(k, f"https://h.invalid/{k}", f"<html><body>{box}{text('abcdef'[k] * 4)}<p>Velu ram situ folka dren pasti.</p></body></html>") for k in range(6)]
    got = {(r["page_id"], r["block_no"]) for r in main_body.found(pages(spark, rows)).collect()}
    assert got == {(k, b) for k in range(6) for b in (4, 5, 9)}  # neither the boxes nor the last line
    nodes, _ = read(rows[0][2], main_body.names_say)
    us = main_body.units(nodes)[1]
    values = [main_body.weights().base(u) for u in us]
    assert all(main_body.best_segments(values, 1e9)[k] for k, u in enumerate(us) if 4 <= nodes[u.first].blocks[-1] <= 9)  # one segment would keep the island


def test_many_repeated_tokens_are_joined(spark, monkeypatch):
    body = lambda k: f"<h1>Lot {'abcdef'[k] * 3}</h1><p>About lot {'abcdef'[k] * 3} nothing is known yet.</p>"
    rows = [(k, f"https://h.invalid/{k}", f"<html><body><p>Velu ram situ folka dren pasti.</p>{body(k)}<p>Zorb flim quast derra moli nanti.</p></body></html>") for k in range(6)]
    few = sorted(map(tuple, main_body.found(pages(spark, rows)).collect()))
    monkeypatch.setattr(main_body, "BROADCAST_TOKENS", 0)
    assert sorted(map(tuple, main_body.found(pages(spark, rows)).collect())) == few == [(k, b) for k in range(6) for b in (2, 3)]


def test_copies_are_not_repetition(spark):
    text = "<h1>Tide guide</h1><h2>Before you go</h2><p>Check the anchor and ask the keeper for the key.</p>"
    rows = [(k, f"https://h{k % 3}.invalid/{k}", page(text)) for k in range(30)]
    assert {(r["page_id"], r["block_no"]) for r in main_body.found(pages(spark, rows)).collect()} == {(k, b) for k in range(30) for b in (5, 6, 7)}


# ---- markup ----

MIXED = """---
owner: x
---
# Title

Text with $a_1$ and a price of $7 here and $41.3 there.

Second
------

- one
   - two \\(b\\)
1) three

~~~
# not a heading
- nor an item $x$
~~~

    indented = 1
    * no item

<!-- <h2>old</h2> -->
<h3>Third</h3><ul><li>four</li></ul>
<pre>## no</pre>

$$
c
$$

h2. Fourth
{code:sql}
h1. no
{code}
== Fifth ==
{math}d{math} and {mathinline}e{mathinline} <math>f &lt; g</math> <div class="math">\\[h\\]</div>
\\section{Sixth}
\\begin{itemize}
  \\item five
\\end{itemize}
\\begin{verbatim}
\\item no
\\end{verbatim}
\\begin{align*}i\\end{align*}

## Attachments:

* [a.pdf](attachments/1.pdf)
"""


def test_elements_of_mixed_markup():
    p = markup.parse(MIXED, render=True)
    of = lambda kind: [t for k, t in p.elements if k == kind]
    assert of("heading") == ["Title", "Second", "Third", "Fourth", "Fifth", "Sixth"]
    assert [t.split(" ")[0] for t in of("list_item")] == ["one", "two", "three", "four", "five"]
    assert len(of("code_block")) == 5
    assert of("formula") == ["a_1", "b", "c", "d", "e", "f < g", "h", "i"]
    assert "owner" not in p.text and "attachments" not in p.text and "# not a heading" in p.text
    for text in ("", "\n" * 5000, "```", "<!--", "$$", "a" * 100_000, "<" * 20_000, "\\[" * 5000, "{code}" * 3001, "    x\n" * 20_000):
        markup.parse(text, render=True)


def test_elements_of_pages_and_files(spark):
    import datetime as d

    vote = '<div class="q7"><p>Rate this</p><ul><li>Splendid</li><li>Dreadful</li></ul></div>'
    rows = [(k, f"https://h.invalid/{k}", page(f"<h1>Page {c}</h1><p>Own words of page {c} stand here, {c * 5} and \\(x\\).</p><ul><li>Item {c}</li></ul>", vote)) for k, c in enumerate("abcdef")]
    rows += [(50, None, None), (51, "https://h.invalid/0", rows[0][2]), rows[1]]
    files = spark.createDataFrame(
        [(1, MIXED, d.datetime(2020, 1, 1), 1), (1, MIXED, d.datetime(2021, 1, 1), 1), (2, None, None, 1), (None, "# x", None, 1), (3, "# a\n- b", None, 1)],
        "file_id long, content string, ingested_at timestamp, row_id long",
    )
    got = clean_markup.found(files, pages(spark, rows)).collect()
    count = lambda o, i, k: sum(r["origin"] == o and r["row_id"] == i and r["kind"] == k for r in got)
    assert [count("md_files", 1, k) for k in markup.KINDS] == [6, 5, 5, 8] and [count("md_files", 3, k) for k in markup.KINDS] == [1, 1, 0, 0]
    # the votes are the same on every page of the host: a template class
    assert {count("html_pages", i, "list_item") for i in (0, 1, 2, 3, 4, 5, 51)} == {1}
    assert {count("html_pages", i, "formula") for i in (0, 1, 5, 51)} == {1}
    assert len(got) == len({tuple(r) for r in got})
    assert clean_markup.found(files.limit(0), pages(spark, [])).count() == 0


def test_the_template_decides(spark, monkeypatch):
    files = spark.createDataFrame([], "file_id long, content string, ingested_at timestamp")
    tail = "<h2>Tokens of trade:</h2><ul><li><a href='/1'>Zorb</a></li></ul><p>Zorb flim quast derra moli nanti.</p>"
    rows = [(k, f"https://h.invalid/{k}", f"<html><body><h1>Gate {k * 'x'}</h1><p>The gate {k * 'x'} opens when the guard has come.</p>{tail}</body></html>") for k in range(1, 7)]
    rows += [(20, "https://small.invalid/1", rows[0][2].replace("Gate", "Door"))]
    headings = lambda: [r["heading"] for r in clean_markup.page_elements(pages(spark, rows)).orderBy("row_id").collect()]
    with_template = headings()
    assert with_template == [1] * 7  # the small host by what the corpus repeats
    assert tuple(clean_markup.without_template(pages(spark, rows)).first()) == (7, 1)
    real = clean_markup.template
    monkeypatch.setattr(clean_markup, "template", lambda rows: real(rows).where("false"))
    assert headings() == [2] * 6 + [1]


def test_classes_in_changing_order_or_crossing_are_no_template(spark):
    p = lambda words: "".join(f"<p>{w} fixed words</p>" for w in words)
    same = [(k, f"https://a.invalid/{k}", f"<h1>T{k * 'x'}</h1>{p(['one', 'two'])}") for k in range(1, 6)]
    mixed = [(k, f"https://b.invalid/{k}", f"<h1>T{k * 'x'}</h1>{p(['one', 'two'] if k % 2 else ['two', 'one'])}") for k in range(11, 16)]
    crossing = [(k, f"https://c.invalid/{k}", f"<h1>T{k * 'x'}</h1>{p(['a1', 'b1', 'a2', 'b2'] if k < 24 else ['b1', 'b2'])}") for k in range(21, 28)]
    rows = main_body.page_rows(pages(spark, same + mixed + crossing))
    got = clean_markup.template(rows).groupBy("host").count().collect()
    host = lambda h: main_body.text_hash(f"{h}.invalid")
    assert {r["host"]: r["count"] for r in got} == {host("a"): 2, host("c"): 2}


def test_copies_and_versions_of_pages_are_no_template(spark):
    files = spark.createDataFrame([], "file_id long, content string, ingested_at timestamp")
    article = "<h1>Tide guide</h1><p>The harbour opens at dawn and {} boats leave.</p><h2>Before you go</h2><ul><li>Check the anchor</li><li>Ask the keeper</li></ul><pre>tide --list</pre><p>Then \\(t+1\\) hours pass.</p>"
    own = lambda c, more="": page(f"<h1>Page {c}</h1><p>Own words of page {c} stand here, {c * 5}.</p>{more}<p>The {c * 4} was seen by nobody else.</p>")
    h = [(k, f"https://h.invalid/{c}", own(c)) for k, c in enumerate("abcdef")]
    h += [(10 + k, f"https://h.invalid/copy{k}", page(article.format("many"))) for k in range(4)]
    h += [(20 + k, f"https://i.invalid/{c}", own(c)) for k, c in enumerate("abcdef")]
    h += [(30 + k, f"https://i.invalid/v{w}", page(article.format(w))) for k, w in enumerate(("red", "blue", "green"))]
    h += [(40 + k, f"https://j.invalid/v{w}", page(article.format(w))) for k, w in enumerate(("red", "blue", "green"))]
    h += [(50 + k, f"https://k.invalid/{c}", own(c, "<h2>Overview of the work</h2><h2>Steps to take</h2>" if k < 3 else "")) for k, c in enumerate("abcdef")]
    got = clean_markup.found(files, pages(spark, h)).groupBy("row_id").pivot("kind", list(markup.KINDS)).count().fillna(0).collect()
    counts = {r["row_id"]: [r[k] for k in markup.KINDS] for r in got}
    for i in (*range(10, 14), *range(30, 33), *range(40, 43)):
        assert counts.get(i) == [2, 2, 1, 1], i
    assert [counts[i][0] for i in range(50, 56)] == [3, 3, 3, 1, 1, 1]


def test_clean_text_of_pages_and_files(spark):
    vote = '<div class="q7"><p>Rate this</p><ul><li>Splendid</li><li>Dreadful</li></ul></div>'
    body = "<h1>Page {0}</h1><p>Own{0} <b>{0}words</b> of{0}<i> page{0}</i> {0} stand <b>h{0}</b>ere{0} and \\(x\\).</p><ul><li>Item {0}<ul><li>Inner {0}</li></ul></li></ul><pre><span>def {0}:</span>\n<span>    {0}</span></pre><p>Then{0} <span class='math'>${0}$</span> holds for {0}.</p>"
    rows = [(k, f"https://h.invalid/{c}", page(body.format(c), vote)) for k, c in enumerate("abcdef")]
    rows += [(50, None, None), (51, "https://h.invalid/a", rows[0][2]), rows[1], (52, "https://h.invalid/z", ""), (None, "https://h.invalid/a", rows[0][2])]
    files = spark.createDataFrame([(1, "# T\n\n* a"), (2, None)], "file_id long, content string")
    got = clean_markup.cleaned(files, pages(spark, rows)).collect()
    want = lambda c: f"# Page {c}\nOwn{c} {c}words of{c} page{c} {c} stand h{c}ere{c} and \\(x\\).\n- Item {c}\n- Inner {c}\n```\ndef {c}:\n    {c}\n```\nThen{c} ${c}$ holds for {c}."
    of = lambda o: sorted(((r["row_id"], r["clean"]) for r in got if r["origin"] == o), key=repr)
    assert of("md_files") == [(1, "# T\n\n- a"), (2, None)]
    every = [(k, want(c)) for k, c in enumerate("abcdef")] + [(1, want("b")), (50, None), (51, want("a")), (52, ""), (None, want("a"))]
    assert of("html_pages") == sorted(every, key=repr)


# ---- subjects ----


def test_subjects(spark):
    import datetime as d

    r = random.Random(0)
    nouns = {"sea": ["harbour wall", "tide table", "anchor chain"], "sky": ["wind sock", "runway lamp", "landing gear"], "law": ["court list", "legal hold", "appeal date"]}
    say = lambda s: f"The {r.choice(nouns[s])} and the {r.choice(nouns[s])} were seen by {r.choice('Ann Bob Cid Dan Eve'.split())} on day {r.randint(1, 99)} again."
    section = lambda s, n: f"# Notes on {r.choice(nouns[s])}\n" + "\n".join(say(s) for _ in range(n)) + "\n"
    files = [(k, section(s, 6), d.datetime(2020, 1, 1), 1) for k, s in enumerate(list(nouns) * 15)]
    files += [(100, section("sea", 5) + section("law", 5), None, 1), (101, section("sky", 9) + section("law", 1), None, 1), (102, "wind sock", None, 1), (103, None, None, 1), (None, section("sea", 5), None, 1)]
    t = spark.createDataFrame(files, "file_id long, content string, ingested_at timestamp, subject long")
    areas = spark.createDataFrame([("sea", "Pages about harbour wall and the like"), ("sky", "Pages about wind sock and the like"), ("law", "Pages about court list and the like"), (None, None)], "subject string, gloss string")
    labels = spark.createDataFrame([(0, "sea"), (1, "sky"), (2, None)], "file_id long, subject string")
    lines = spark.createDataFrame([(0, "Categories: Ships"), (1, None)], "file_id long, extracted_categories string")
    got = {tuple(x) for x in subjects.found(t, lines, labels, areas).collect()}
    want = {(k, s) for k, s in enumerate(list(nouns) * 15)} | {(100, "sea"), (100, "law"), (101, "sky")}
    assert got == want
    assert subjects.found(t.limit(0), lines.limit(0), labels.limit(0), areas.limit(0)).count() == 0


def test_only_pairs_of_terms_tell_the_class(spark):
    r = random.Random(7)
    pairs = {"sea": [("copper", "lamp"), ("silver", "chair")], "sky": [("copper", "chair"), ("silver", "lamp")]}
    names = "Ann Bob Cid Dan Eve Fay Gus Hal".split()
    say = lambda s: "{0} saw the {1} thing and then a {2} with {3}.".format(r.choice(names), *r.choice(pairs[s]), r.choice(names))
    lines = [(s, False, subjects.terms(say(s))) for s in ("sea", "sky") for _ in range(150)]
    rules = subjects.mine(spark.createDataFrame(lines, "class string, held boolean, items array<string>"), 6)
    bodies = {(frozenset(b), s) for b, s, _, _ in rules}
    assert all((frozenset(p), s) in bodies for s, x in pairs.items() for p in x)
    assert all(len(b) == subjects.MAX_TERMS for b, _, c, n in rules if {"copper", "silver", "lamp", "chair"} & set(b))
    areas = spark.createDataFrame([("sea", "none"), ("sky", "nothing")], "subject string, gloss string")
    content = lambda s: "# Notes\n" + "\n\n".join(say(s) for _ in range(12))
    kinds = ["sea", "sky"] * 60
    files = spark.createDataFrame([(k, content(s), None) for k, s in enumerate(kinds)], "file_id long, content string, ingested_at timestamp")
    labels = spark.createDataFrame([(k, s) for k, s in enumerate(kinds) if k < 60], "file_id long, subject string")
    said = spark.createDataFrame([], "file_id long, extracted_categories string")
    got = {(x["file_id"], x["subject"]) for x in subjects.found(files, said, labels, areas).collect()}
    assert len(got & set(enumerate(kinds))) >= 115 and len(got) <= 125


def test_rules_against_brute_force(spark):
    r = random.Random(3)
    lines = [(r.choice("AB"), [x for x in "abcdef" if r.random() < 0.5]) for _ in range(120)]
    got = {(b, s): (c, n) for b, s, c, n in subjects.mine(spark.createDataFrame(lines, "class string, items array<string>"), 6)}
    import itertools

    conf, want = {}, {}
    for size in (1, 2):
        for body in itertools.combinations("abcdef", size):
            on = [c for c, x in lines if set(body) <= set(x)]
            for s in "AB":
                conf[body, s] = on.count(s) / len(on) if on else 0
                if len(on) < 6 or conf[body, s] < subjects.MIN_CONFIDENCE:
                    continue
                worth = lambda part: subjects.gains(on.count(s), len(on), part)  # noqa: B023, E731
                if size == 1 or all(worth(conf[(x,), s]) for x in body):
                    want[body, s] = (conf[body, s], len(on))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_any_length_against_brute_force(spark, seed):
    import itertools

    r = random.Random(seed)
    lines = []
    for _ in range(900):
        x = [y for y in "abcdefg" if r.random() < 0.55] + [y for y in "hij" if r.random() < 0.3]
        told = "C" if {"e", "f"} <= set(x) and "a" not in x and r.random() < 0.8 else "B" if r.random() < 0.95 else r.choice("ABC")
        # h alone is nearly sure of B, and of A beside both i and j
        lines.append(("A" if {"a", "b", "c", "d"} <= set(x) or {"h", "i", "j"} <= set(x) else "B" if "h" in x else told, x))
    rules = subjects.mine(spark.createDataFrame(lines, "class string, items array<string>"), 6)
    got = {(b, s): (c, n) for b, s, c, n in rules}
    conf, want = {}, {}
    sets = [(c, frozenset(x)) for c, x in lines]
    for size in range(1, 8):
        for body in itertools.combinations("abcdefghij", size):
            on = [c for c, x in sets if x.issuperset(body)]
            for s in "ABC":
                conf[body, s] = on.count(s) / len(on) if on else 0
                parts = (p for k in range(1, size) for p in itertools.combinations(body, k))
                if len(on) >= 6 and on.count(s) >= subjects.MIN_CONFIDENCE * len(on) and all(subjects.gains(on.count(s), len(on), conf[p, s]) for p in parts):
                    want[body, s] = (conf[body, s], len(on))
    assert got == want
    assert (("a", "b", "c", "d"), "A") in got and (("h", "i", "j"), "A") in got and conf[("h",), "B"] > 1 - subjects.GAIN


def test_phrases(spark):
    df = spark.createDataFrame([(1, "Categories: 1. Law Office, 2. None found"), (2, "None"), (3, "Categories:\n- A-B\n- C"), (4, " CATEGORIES : x / y, etc."), (None, "q")], "file_id long, extracted_categories string")
    assert sorted(map(tuple, subjects.phrases(df).collect())) == [(1, "law office"), (1, "none found"), (3, "a-b"), (3, "c"), (4, "x"), (4, "y")]


def _read_line_by_line(rules, section):
    """Words and evidence by subject of a section, by its lines one after another."""
    import collections

    single, more = collections.defaultdict(list), collections.defaultdict(list)
    for body, subject, v in rules:
        (single if len(body) == 1 else more)[body[0]].append((frozenset(body), subject, v))
    found, n = collections.Counter(), 0
    for line in section:
        n += sum(1 for x in line.split() if len(x) > 1 or x not in "|-–—+*/=<>&#.:")
        words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", line.lower())
        near = {f"{a} {b}" for a, b in zip(words, words[1:])}
        have = {*words, *near}
        own = (set(words) & single.keys()) - {w for x in near & single.keys() for w in x.split()} | near & single.keys()
        for x in own:
            for _, subject, v in single[x]:
                found[subject] += v
        for x in have & more.keys():
            for body, subject, v in more[x]:
                if body <= have:
                    found[subject] += v
    return n, {s: v for s, v in found.items() if v}


def _rules_and_sections(words, many):
    r = random.Random(11)
    vocabulary = [a + b for a in "ba ce di fo gu ha".split() for b in ("l n r s t x Σ ß é-a é".split() + ["İk"])[:words]]
    known = [*dict.fromkeys(v.lower() for v in vocabulary if v.isalpha() and v.lower().isalpha() or "-" in v)]
    near = [f"{a} {b}" for a, b in itertools.product(known, known) if r.random() < 0.1]
    bodies = [(x,) for x in r.sample([*known, *near], len(known) + len(near) // 2)]
    bodies += [*{tuple(sorted(r.sample([*known, *near[:40]], k))) for k in (2, 2, 2, 3, 4) for _ in range(60)}]
    rules = [(body, r.choice("ABCDE"), r.randint(1, 60) / 8) for body in bodies]
    ends = ["", "", "", "", ",", ".", "/", " - ", " 7 ", " | ", "_x", "/" + vocabulary[0], " &"]
    line = lambda: " ".join(r.choice([str.lower, str.title, str])(r.choice([*vocabulary, "unknown"])) + r.choice(ends) for _ in range(r.randint(1, 16)))
    return rules, [[line() for _ in range(r.randint(1, 9))] for _ in range(many)]


@pytest.mark.parametrize("small", [False, True])
def test_evidence_of_many_lines_is_that_of_each(monkeypatch, small):
    rules, sections = _rules_and_sections(11, 150)
    if small:  # many blocks, and tokens are forgotten
        for name, value in (("CHARS", 300), ("BLOCK", 3), ("TOKENS", 9)):
            monkeypatch.setattr(subjects, name, value)
    book = subjects.RuleBook(rules)
    want = [_read_line_by_line(rules, x) for x in sections]
    for section, (n, evidence) in zip(sections, want):
        words, got = book.evidence(section, np.zeros(len(section), np.int64), 1)
        assert (int(words[0]), {s: v for s, v in zip(book.names, got[0].tolist()) if v}) == (n, evidence)
    got = subjects.shares(sections, book)
    assert sum(len(held) > 1 for held, _ in got) > 20 and [n for _, n in got] == [n for n, _ in want]
    assert got == [x for section in sections for x in subjects.shares([section], book)]
    for (held, n), (_, evidence), section in zip(got, want, sections):
        top = sorted(evidence, key=lambda s: (-evidence[s], s))
        if len(top) < 2 or evidence[top[1]] <= subjects.CHANGE:
            assert held == ({top[0]: n} if top else {})
        else:
            units = [_read_line_by_line(rules, [u]) for line in section for u in re.split(r"(?<=[.!?])\s+", line)]
            deals = {}
            for (k, _), s in zip(units, subjects.runs([e for _, e in units])):
                deals[s] = deals.get(s, 0) + k
            assert held == (deals or {top[0]: n})
    assert subjects.shares([], book) == [] and subjects.shares([["a b -"]], subjects.RuleBook([])) == [({}, 2)]


def test_evidence_of_many_lines_costs_less_than_of_each():
    rules, sections = _rules_and_sections(8, 600)
    rules = [(body, "A", v) for body, _, v in rules]
    book = subjects.RuleBook(rules)
    spent = {}
    for what, run in (("each", lambda: [_read_line_by_line(rules, x) for x in sections]), ("all", lambda: subjects.shares(sections, book))):
        times = []
        for _ in range(3):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        spent[what] = min(times)
    assert spent["all"] < 0.2 * spent["each"]


def test_equal_evidence_is_equal_in_any_order():
    values = [0.1, 0.2, 0.3, 0.7]  # as floats their sum depends on the order
    rules = [((f"{s}{k}",), s, v) for s, order in (("b", values), ("a", values[::-1])) for k, v in zip("wxyz", order)]
    held = subjects.shares([["bw bx by bz aw ax ay az"], ["aw ax ay az bw bx by bz"], ["bx ay"], ["bw bx by ax ay az"]], subjects.RuleBook(rules))
    assert held == [({"a": 8}, 8), ({"a": 8}, 8), ({"a": 2}, 2), ({"a": 6}, 6)]


def test_runs_against_brute_force():
    import itertools

    r = random.Random(3)
    for _ in range(60):
        units = [{s: r.choice([0, 0, 2.0, 3.5]) for s in "abc" if r.random() < 0.6} for _ in range(6)]
        names = sorted({s for u in units for s in u})
        if not names:
            continue
        worth = lambda path: sum(u.get(s, 0) for u, s in zip(units, path)) - subjects.CHANGE * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
        assert worth(subjects.runs(units)) == max(worth(p) for p in itertools.product(names, repeat=6))
