"""A lenient reader of HTML pages: text nodes with the elements they stand in, in one regular scan."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

_TOKEN = re.compile(
    r"(<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\2\s*>|\Z)|<![^>]*>)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_IN_PAGE = re.compile(r"\bhref\s*=\s*[\"']?#", re.I)
VOID = frozenset("br img hr meta input link area base col embed source track wbr".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("h1 h2 h3 h4 h5 h6 p li pre ul ol div table section article main aside nav header footer blockquote".split())
_LINES, _HOLD_LINES = HEADINGS | {"p"}, frozenset("td th li div blockquote section article main aside".split())
_ITEMS, _HOLD_ITEMS = frozenset(("li",)), frozenset(("ul", "ol"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img"
    " math mi mn mo mrow msup msub msubsup mfrac msqrt mroot mtext mstyle mover munder semantics annotation".split()
)
#: So many open elements; at the limit the innermost one ends where the next begins, so that every element still holds its own text.
DEPTH = 256
#: Elements that set a part of a page apart.
BOXES = frozenset("div section article main aside nav header footer form".split())
#: Kinds of blocks: heading, list item, code block; else 3.
KIND = dict.fromkeys(HEADINGS, 0) | {"li": 1, "pre": 2}
FORMULA = re.compile(
    r"(?<!\\)\$\$.+?\$\$|(?<!\\)\\\[.+?\\\]|(?<!\\)\\\(.+?\\\)|(?<![\\$])\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?![\d$])", re.S
)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+(?:\.pdf)?")


@dataclass(slots=True)
class Node:
    """A text node: its text, the numbers of the open blocks (innermost last), and the names of the open elements.

    ``holder`` numbers the innermost element that isn't inline, ``boxes`` the open boxes; ``under`` is the place of the heading before it
    in an enclosing element (-1: none), ``anchor`` tells a link to a place of the same page."""

    text: str
    blocks: tuple[int, ...]
    path: tuple[str, ...]
    link: bool
    tags: int  # tags since the last text node
    under: int = -1
    before: str = ""  # blank text since the last text node; elements that aren't inline count as a line's end
    holder: int = 0
    boxes: tuple[int, ...] = ()
    anchor: bool = False
    math: bool = False
    says: frozenset[str] = frozenset()  # what names say about the place, by the function given to ``read``


@dataclass(slots=True)
class _Frame:
    """An open element, with what it and the elements round it say about a text node."""

    name: str
    blocks: tuple[int, ...] = ()
    path: tuple[str, ...] = ()
    boxes: tuple[int, ...] = ()
    holder: int = 0
    under: int = -1
    anchor: bool = False
    math: bool = False
    says: frozenset[str] = frozenset()


def words(text: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", text.lower()))


@lru_cache(20_000)
def cues_of(name: str, attributes: str) -> tuple[str, ...]:
    found = [name]
    if attributes:
        for key, a, b in _ATTRIBUTE.findall(attributes):
            for value in (a or b).lower().split():
                found.append(f"{key.lower()}={_DIGITS.sub('0', value)}")
    return tuple(found)


def read(page: str, say: Callable[[tuple[str, ...]], frozenset[str]] = lambda cues: frozenset()) -> tuple[list[Node], dict[int, str]]:
    """The text nodes of a page, and the name of each numbered block (h1 to h6, p, li and pre, from 1).

    ``say`` tells what the cues of one element say about all text in it."""
    nodes: list[Node] = []
    blocks: dict[int, str] = {}
    stack: list[_Frame] = [_Frame("")]
    number, links, tags = 0, 0, 0
    blank: list[str] = []
    heading = -1  # place of the open heading's first text
    elements = 0

    def close(k: int) -> None:
        nonlocal links, heading
        for frame in stack[k:]:
            if frame.name == "a":
                links -= 1
            elif frame.name in HEADINGS and heading >= 0:
                stack[k - 1].under = heading
                heading = -1
        del stack[k:]

    def nearest(names: frozenset[str], stops: frozenset[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in stops:
                return 0
        return 0

    for m in _TOKEN.finditer(page):
        skipped, _, slash, name, attributes, text = m.groups()
        if skipped is not None:
            continue
        if text is not None:
            if text.isspace():
                blank.append(text)
                continue
            if "&" in text:
                text = html.unescape(text)
                if text.isspace():
                    blank.append(text)
                    continue
            f = stack[-1]
            if heading < 0 and not HEADINGS.isdisjoint(f.path[-4:]):
                heading = len(nodes)
            nodes.append(Node(text, f.blocks, f.path, links > 0, tags, f.under, "".join(blank), f.holder, f.boxes, f.anchor, f.math, f.says))
            tags = 0
            blank.clear()
            continue
        name = name.lower()
        tags += 1
        if name not in INLINE:
            blank.append("\n")
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            continue
        if name in ENDS_P:
            k = nearest(_LINES, _HOLD_LINES)
            if k:
                close(k)
        if name == "li":
            k = nearest(_ITEMS, _HOLD_ITEMS)
            if k:
                close(k)
        if name in BLOCKS:
            number += 1
            blocks[number] = name
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "a":
            links += 1
        if len(stack) > DEPTH:
            close(DEPTH)
        elements += 1
        f = stack[-1]
        cues = cues_of(name, attributes)
        more = say(cues)
        stack.append(
            _Frame(
                name,
                (*f.blocks, number) if name in BLOCKS else f.blocks,
                (*f.path, name),
                (*f.boxes, elements) if name in BOXES else f.boxes,
                f.holder if name in INLINE else elements,
                f.under,
                f.anchor or (name == "a" and _IN_PAGE.search(attributes) is not None),
                f.math or name == "math" or "class=math" in cues,
                f.says if more <= f.says else f.says | more,
            )
        )
    return nodes, blocks
