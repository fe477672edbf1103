"""Problem 5: page boilerplate mixed with main content.

Method: maximum-scoring subsequence.  A page is a sequence of words and tags; words score by a linear
model, fitted on the labelled pages of ``labelled_pages`` (positive for the article, negative for
furniture), tags score negative.  The scan is the exact form for several segments: of all choices of
contiguous segments it finds the one with the greatest sum less ``CUT`` for every segment after the
first, in one pass.  Nothing else decides: an island is taken out of the article if what its words and
tags lose is more than the cut costs, furniture at both ends if its sum isn't positive.

The model knows no wording, only signals that carry over from page to page and from site to site:
whether a unit (the text of one element) is linked, or linked to a place of its own page; whether it
stands before the title, or in a box that doesn't hold the title; its element; names of classes, ids
and roles that publishing software uses; whether it is a sentence; and repetition: whether the unit,
a link in it or the heading above it stands on many pages of the host.

* One pass over whole pages gives a row a page: hashes of its units and their scores without repetition.
* Hashes are counted by host, first by pages, which ends most of them, then by distinct titles, so that
  copies, versions and pages fetched again count once; counts are exact and over all pages.  A text is
  repeated if it stands under at least ``SUPPORT`` titles and ``SHARE`` of the host's; hosts with fewer
  than ``SMALL`` titles are also counted together.
* The scan runs on the rows, where they lie.

Defined cases: null ids and null, empty or unreadable pages give no row; unclosed elements end with
the enclosing one; a block counts if it, or a block inside it, has text in a segment; ties in the sum go
to the earlier and shorter choice; a page fetched again is a page of its own; a page without first-level
heading has no signals of place; pages without URL form a host of their own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.html_tokens import FORMULA, HEADINGS, KIND, Node, read, words
from quillmere.llm.labelled_pages import SITES
from quillmere.plans.cut import cut

SUPPORT = 3
SHARE = 0.05
#: Hosts with fewer titles are taken together, as they show little repetition of their own.
SMALL = 20
#: Beyond it repeated tokens are joined to their pages, not sent to the workers.
BROADCAST_TOKENS = 500_000
#: What every segment after the first costs.
CUT = 6.0
RIDGE = 0.3
#: The least that a tag costs, whatever the labelled pages say.
TAG_SCORE = -0.05
#: Parts of class names, ids and roles that publishing software gives to furniture and to articles.
FURNITURE = re.compile(r"nav|menu|crumb|side|foot|head(?!ing)|banner|comment|discuss|disqus|relat|promo|advert|sponsor|social|share|cookie|consent|meta|byline|attach|copyright|licen[cs]e|printfooter|catlinks|toc|widget|rating|contentinfo|complementary|search|login|pager")
ARTICLE = re.compile(r"article|content(?!info)|body|entry|post|story|main|text")
LANDMARKS = frozenset("nav aside header footer main article form".split())
#: Signals that need the other pages.
REPEATED, LINK_REPEATED, UNDER_REPEATED, BOXED_UNDER_REPEATED = "repeated", "link repeated", "under repeated", "boxed under repeated"
REPEATED_OPENING = "repeated opening"
#: Where a unit stands: in a box without the title; or as a heading outside of such boxes that opens text which isn't linked.
BOXED, OPENING = 1, 2
_KEPT = re.compile(r"\{\{(.*?)\}\}", re.S)
_TEXT = re.compile(r">([^<]*[^<\s][^<]*)<")
_MARK = re.compile(r"[$\\]")
_SENTENCE = re.compile(r"\w\W{0,3}[.!?。！？][\"'”»)\]]*\s*$")
#: So many words of one unit make running text, with a full stop or without.
RUNNING = 9


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].lower() if m else ""


@dataclass(slots=True)
class Unit:
    """The text of one element that isn't inline, without that of elements in it that aren't inline either."""

    first: int
    end: int  # its nodes, half-open
    signals: tuple[str, ...]
    words: int
    tags: int
    token: int  # hash of its element and its words without the site's name; 0 without a word
    link: int  # the same of its last link
    under: int  # the unit that is the heading above it, or -1
    place: int


@lru_cache(20_000)
def names_say(cues: tuple[str, ...]) -> frozenset[str]:
    """Signals of an element's name, classes, id and role."""
    found = {f"in {c}" for c in cues if c in LANDMARKS}
    for c in cues:
        if "=" in c:
            value = c.split("=", 1)[1]
            if FURNITURE.search(value):
                found.add("furniture name")
            elif ARTICLE.search(value):
                found.add("article name")
    return frozenset(found)


def _covered(ws: list[str], site: set[str]) -> str:
    return " ".join(ws) if site.isdisjoint(ws) else " ".join(["*" if w in site else w for w in ws])


def units(nodes: list[Node]) -> tuple[int, list[Unit]]:
    """Hash of the page's title (0: none), and its units in order."""
    spans: list[tuple[int, int]] = []
    named_title: list[str] = []
    k = 0
    while k < len(nodes):
        e, n = k + 1, nodes[k]
        while e < len(nodes) and nodes[e].holder == n.holder:
            e += 1
        if n.path[-1:] == ("title",):
            named_title += [x.text for x in nodes[k:e]]
        elif n.path[1:2] != ("head",):
            spans.append((k, e))
        k = e
    title = words(" ".join(named_title))
    line = " ".join(title)
    heads = [(a, b) for a, b in spans if "h1" in nodes[a].path]
    named = [words(" ".join(n.text for n in nodes[a:b])) for a, b in heads]
    at = next((i for i, w in enumerate(named) if w and " ".join(w) in line), 0)
    head = heads[at][0] if heads else -1
    site = set(title) - set(named[at]) if heads and named[at] and " ".join(named[at]) in line else set()
    index = {a: i for i, (a, _) in enumerate(spans)}
    home = nodes[head].boxes if head >= 0 else ()
    found: list[Unit] = []
    known: dict[tuple, tuple[tuple[str, ...], int, bool]] = {}
    for a, b in spans:
        n = nodes[a]
        last = n.path[-1] if n.path else ""
        key = (n.says, n.boxes, a < head, n.path[-3:], len(n.blocks))
        fixed = known.get(key)
        if fixed is None:
            s = set(n.says)
            boxed = False
            if head >= 0:
                common = 0
                while common < min(len(home), len(n.boxes)) and home[common] == n.boxes[common]:
                    common += 1
                boxed = len(n.boxes) > common
                s |= {x for x, yes in (("before title", a < head), ("boxed", boxed), ("beside title", common < len(home))) if yes}
            s |= {x for x, yes in (("heading", last in HEADINGS), ("list", "li" in n.path), ("cell", last in ("td", "th")), ("code", "pre" in n.path)) if yes}
            fixed = known[key] = (tuple(sorted(s)), BOXED if boxed else 0, "pre" in n.path)
        signals, place, exact = fixed
        if b == a + 1:
            text, tags, ws, linked, alone, plain = n.text, n.tags, words(n.text), n.link, "", not n.link
        else:
            part = nodes[a:b]
            text, tags, linked, alone, plain = "".join([x.text for x in part]), sum([x.tags for x in part]), False, "", False
            ws = []
            for x in part:
                own = words(x.text)
                ws += own
                if x.link:
                    linked, alone = True, x.text
                elif own:
                    plain = True
        more = signals
        if linked and not plain:
            more = (*signals, "in-page link" if any([x.anchor for x in nodes[a:b]]) else "linked")
        elif any([x.math for x in nodes[a:b]]) or (_MARK.search(text) and FORMULA.fullmatch(text.strip())):
            more, exact = (*signals, "formula"), True  # its numbers aren't slots, nor are those of code
        elif last not in HEADINGS:
            if _SENTENCE.search(text[-20:]):
                more = (*more, "sentence")
            if len(ws) >= RUNNING:
                more = (*more, "running text")
        if head == a:
            more = (*more, "title")
        plain_words = [w for w in ws if w != "0"]
        token = link = 0
        if plain_words:
            token = text_hash(f"{last}\1{text if exact else _covered(ws, site)}")
            if alone and plain:
                link = text_hash("a\1" + _covered(words(alone), site))
        found.append(Unit(a, b, more, len(plain_words) or 1, tags, token, link, index.get(n.under, -1), place))
    for k, u in enumerate(found):
        if u.under == k:
            u.under = -1
        if not u.place and "heading" in u.signals and k + 1 < len(found):
            after = found[k + 1]
            if after.place != BOXED and not {"linked", "in-page link"} & set(after.signals):
                u.place = OPENING
    key = " ".join(named_title).lower() + "\1" + " ".join(n.text for a, b in heads[at : at + 1] for n in nodes[a:b]).lower()
    return text_hash(key) if len(key) > 1 else 0, found


def repetition(tokens: list[int], links: list[int], under: list[int], places: list[int], repeated: set[int]) -> list[list[str]]:
    """The signals of each unit that need the other pages."""
    own = [t in repeated for t in tokens]
    found = []
    for r, link, at, place in zip(own, links, under, places):
        s = [REPEATED] if r else []
        if r and place == OPENING:
            s.append(REPEATED_OPENING)
        if link in repeated:
            s.append(LINK_REPEATED)
        if at >= 0 and own[at]:
            s += [UNDER_REPEATED, BOXED_UNDER_REPEATED] if place == BOXED else [UNDER_REPEATED]
        found.append(s)
    return found


def columns(us: list[Unit]) -> tuple[list, list, list, list]:
    return [u.token for u in us], [u.link for u in us], [u.under for u in us], [u.place for u in us]


def is_repeated(titles: int, of: int) -> bool:
    return titles >= SUPPORT and titles >= SHARE * of


class Weights:
    """A logistic model of the labelled pages."""

    def __init__(self) -> None:
        rows: list[tuple[dict[str, float], bool, float]] = []
        for site in SITES:
            read_pages, on = [], defaultdict(set)
            for k, page in enumerate(site):
                nodes, _ = read(_KEPT.sub(lambda m: _TEXT.sub(r">¤\1<", m[0]), page).replace("{{", "").replace("}}", ""), names_say)
                inside = [n.text.startswith("¤") for n in nodes]
                for n in nodes:
                    n.text = n.text.lstrip("¤")
                us = units(nodes)[1]
                read_pages.append((us, inside))
                for u in us:
                    on[u.token].add(k)
                    on[u.link].add(k)
            repeated = {t for t, x in on.items() if t and is_repeated(len(x), len(site))}
            for us, inside in read_pages:
                for known, share in ((repeated, 1.0), (set(), 0.3)):  # hosts of few pages show no repetition
                    for u, more in zip(us, repetition(*columns(us), known)):
                        x = dict.fromkeys((*u.signals, *more), 1.0)
                        x["tags"] = u.tags / u.words
                        rows.append((x, inside[u.first], share * u.words**0.5))
        names = sorted({s for x, _, _ in rows for s in x})
        index = {s: k for k, s in enumerate(names)}
        design = np.zeros((len(rows), len(names) + 1))
        design[:, -1] = 1
        for k, (x, _, _) in enumerate(rows):
            for s, v in x.items():
                design[k, index[s]] = v
        y, share = np.array([i for _, i, _ in rows], float), np.array([w for _, _, w in rows])
        ridge = np.full(len(names) + 1, RIDGE)
        ridge[-1] = 1e-3
        weight = np.zeros(len(names) + 1)
        for _ in range(15):  # Newton steps
            p = 1 / (1 + np.exp(-design @ weight))
            slope = design.T @ (share * (p - y)) + ridge * weight
            bend = (design * (share * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
            weight -= np.linalg.solve(bend, slope)
        self.signal = {s: float(weight[k]) for s, k in index.items() if s != "tags"}
        self.word = float(weight[-1])
        self.tag = min(TAG_SCORE, float(weight[index["tags"]]))

    def base(self, u: Unit) -> float:
        """Sum of the scores of a unit's words and tags, as far as its own page tells."""
        return u.words * (self.word + sum(self.signal.get(s, 0.0) for s in u.signals)) + u.tags * self.tag

    def values(self, base: list[float], words: list[int], tokens: list[int], links: list[int], under: list[int], places: list[int], repeated: set[int]) -> list[float]:
        """The sums of a page's units, by what is known to be repeated."""
        if not repeated:
            return base
        more = repetition(tokens, links, under, places, repeated)
        return [v + k * sum(self.signal.get(s, 0.0) for s in signals) if signals else v for v, k, signals in zip(base, words, more)]


@cache
def weights() -> Weights:
    return Weights()


def best_segments(values: list[float], cost: float = CUT) -> list[bool]:
    """Which values are in the segments of greatest sum, less ``cost`` for each segment after the first."""
    inside, after = -1.0, -1e300  # sums of the best choices that end inside a segment, or after one
    came: list[tuple[bool, int]] = []  # (a segment goes on or ended here, whence the inside came: 0 new, 1 inside, 2 after)
    best, at = 0.0, -1
    started = False
    for k, v in enumerate(values):
        options = [(0.0, 0)]
        if started:
            options += [(inside, 1), (after - cost, 2)]
        top, whence = max(options, key=lambda o: o[0] + 1e-12 * (o[1] == 0))
        later = max(after, inside) if started else -1e300
        came.append((started and inside > after, whence))
        inside, after, started = top + v, later, True
        if inside > best + 1e-12:
            best, at = inside, k
    keep = [False] * len(values)
    k, state = at, True
    while k >= 0:
        ended, whence = came[k]
        if state:
            keep[k] = True
            if whence == 0:
                break
            state = whence == 1
        else:
            state = ended
        k -= 1
    return keep


#: A row a page, with arrays of a value a unit.  ``blocks`` holds 4 x number + kind (0 heading, 1 list item, 2 code block, 3 paragraph).
ROWS = (
    "page_id bigint, key bigint, host bigint, title bigint, tokens array<bigint>, links array<bigint>, base array<double>, words array<int>, under array<int>, "
    "places array<int>, blocks array<array<bigint>>, formulas array<int>"
)
#: The text nodes of each unit: what stands before them, their text, and whether they are a formula.
PARTS = ", parts array<array<struct<before:string,text:string,formula:boolean>>>"
_PART = pa.struct([("before", pa.string()), ("text", pa.string()), ("formula", pa.bool_())])
_KINDS = (pa.int64(),) * 4 + (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int32()))


def formulas(nodes: list[Node]) -> int:
    return 0 if "pre" in nodes[0].path else sum([1 if n.math else len(FORMULA.findall(n.text)) if _MARK.search(n.text) else 0 for n in nodes])


def page_rows(pages: DataFrame, texts: bool = False, with_null_ids: bool = False) -> DataFrame:
    """``ROWS`` of the pages with content, with ``PARTS`` if texts are asked for."""
    schema = ROWS + (PARTS if texts else "")
    kinds = _KINDS + ((pa.list_(pa.list_(_PART)),) if texts else ())
    names = [c.split(" ")[0] for c in schema.replace("struct<before:string,text:string,formula:boolean>", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for page, url, content, key in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    nodes, names_of = read(content, names_say)
                    title, us = units(nodes)
                    title = title or (text_hash(url) if url else key)
                    blocks = [sorted({4 * b + KIND.get(names_of[b], 3) for n in nodes[u.first : u.end] for b in n.blocks}) for u in us]
                    row = (page, key, text_hash(host_of(url)), title, *columns(us)[:2], [w.base(u) for u in us], [u.words for u in us], *columns(us)[2:], blocks)
                    row += ([formulas(nodes[u.first : u.end]) for u in us],)
                    if texts:
                        row += ([[{"before": n.before, "text": n.text, "formula": n.math} for n in nodes[u.first : u.end]] for u in us],)
                    out.append(row)
                values = list(zip(*out)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, kinds)], names=names)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html_content").cast("string"), page_key().alias("key"))
    return rows.where("length(html_content) > 0" if with_null_ids else "page_id is not null and length(html_content) > 0").mapInArrow(run, schema)


def page_key() -> Column:
    """Tells rows of other id, URL or content apart."""
    return F.xxhash64(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html_content").cast("string"))


def host_sizes(rows: DataFrame) -> DataFrame:
    """(host, of): its number of titles."""
    return rows.select("host", "title").distinct().groupBy("host").agg(F.count("*").alias("of"))


def candidates(rows: DataFrame) -> DataFrame:
    """(host, title, place, token, words): where tokens stand that have ``SUPPORT`` pages of their host, or whose host is small; links have no words."""
    of_page = F.filter(F.array_distinct(F.concat("tokens", "links")), lambda x: x != 0)
    often = rows.select("host", F.explode(of_page).alias("token")).groupBy("host", "token").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    often = cut(often.select("host", "token"), "often")  # the bulk of all tokens stands on one page and ends here
    units = rows.select("host", "title", F.posexplode(F.arrays_zip("tokens", "links", "words")).alias("place", "u"))
    own = units.select("host", "title", "place", F.col("u.tokens").alias("token"), F.col("u.words").alias("words"))
    link = units.select("host", "title", "place", F.col("u.links").alias("token"), F.lit(0).alias("words")).where("token <> 0")
    return own.union(link).join(often, ["host", "token"], "left_semi")


def pooled(rows: DataFrame) -> DataFrame:
    """(host, token): what the pages of small hosts repeat, taken together; for each such host its own tokens of these."""
    small = host_sizes(rows).where(F.col("of") < SMALL).select("host")
    of_page = F.filter(F.array_distinct(F.concat("tokens", "links")), lambda x: x != 0)
    on = cut(rows.join(small, "host", "left_semi").select("host", "title", F.explode(of_page).alias("token")).distinct(), "pooled")
    total = on.select("title").distinct().agg(F.count("*").alias("of"))
    counts = on.select("token", "title").distinct().groupBy("token").agg(F.count("*").alias("n"))
    limit = total.first()["of"]
    return on.join(counts.where((F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.lit(limit))), "token", "left_semi").select("host", "token").distinct()


def repeated_on_hosts(rows: DataFrame) -> DataFrame:
    """(host, token) repeated on a host, or on small hosts taken together."""
    on = candidates(rows).select("host", "token", "title").distinct().groupBy("host", "token").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    return on.join(host_sizes(rows), "host").where(F.col("n") >= SHARE * F.col("of")).select("host", "token").union(pooled(rows))


SCANNED = ["host", "tokens", "links", "base", "words", "under", "places"]


def scanned(rows: DataFrame, repeated: DataFrame, columns: list[str], handle: Callable, schema: str, kinds: tuple) -> DataFrame:
    """The scan over page rows, given the repeated (host, token); ``handle(keep, *columns)`` gives a page's row of the result, or None.

    Up to ``BROADCAST_TOKENS`` repeated tokens go to the workers, so that page rows never move; more of them are joined to the pages."""
    repeated = cut(repeated.distinct(), "repeated")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    small = repeated.count() <= BROADCAST_TOKENS
    if small:
        table: dict[int, set[int]] = defaultdict(set)
        for r in repeated.collect():  # at most BROADCAST_TOKENS pairs of numbers
            table[r["host"]].add(r["token"])
        shipped = rows.sparkSession.sparkContext.broadcast(dict(table))
        ready = rows.select(*SCANNED, *columns)
    else:
        of_page = F.filter(F.array_distinct(F.concat("tokens", "links")), lambda x: x != 0)
        hits = rows.select("key", "host", F.explode(of_page).alias("token")).join(repeated, ["host", "token"], "left_semi")
        hits = hits.groupBy("key").agg(F.collect_set("token").alias("repeated"))  # at most a page's own tokens
        ready = rows.join(hits, "key", "left").select(*SCANNED, "repeated", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        nothing: set[int] = set()
        for batch in batches:
            host, tokens, links, base, words, under, places, *more = (c.to_pylist() for c in batch.columns)
            known = [shipped.value.get(h, nothing) for h in host] if small else [set(x or ()) for x in more.pop(0)]
            out = []
            for t, link, v, k, u, p, r, *x in zip(tokens, links, base, words, under, places, known, *more):
                row = handle(best_segments(w.values(v, k, t, link, u, p, r)), *x)
                if row is not None:
                    out.append(row)
            values = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, kinds)], names=names)

    return ready.mapInArrow(run, schema)


def joined(parts: list[list[dict]], codes: list[list[int]]) -> str:
    """The text of units: a line each, code as it stands."""
    lines = []
    for unit, held in zip(parts, codes):
        text = "".join(p["before"] + p["text"] if k else p["text"] for k, p in enumerate(unit))
        lines.append(text if any(c % 4 == 2 for c in held) else " ".join(text.split()))
    return "\n".join(lines).strip()


def bodies(pages: DataFrame, texts: bool = True) -> DataFrame:
    """(page_id, blocks, main_text) of every page that has a main body; without texts ``main_text`` is null."""

    def handle(keep: list[bool], page: int, codes: list[list[int]], parts: list | None = None) -> tuple | None:
        kept = [k for k, good in enumerate(keep) if good]
        text = joined([parts[k] for k in kept], [codes[k] for k in kept]) if parts is not None else None
        return (page, sorted({b >> 2 for k in kept for b in codes[k]}), text) if kept else None

    rows = cut(page_rows(pages, texts), "pages")
    columns = ["page_id", "blocks", *(["parts"] if texts else [])]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.string())
    return scanned(rows, repeated_on_hosts(rows), columns, handle, "page_id bigint, blocks array<bigint>, main_text string", kinds)


def found(pages: DataFrame) -> DataFrame:
    """(page_id, block_no) of the blocks of the main body."""
    return bodies(pages, texts=False).select("page_id", F.explode("blocks").alias("block_no")).distinct()
