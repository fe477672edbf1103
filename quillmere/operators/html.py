"""HTML: removal of the page footer, and conversion to Markdown.  Nesting needs a parser, so both run in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_DIV = re.compile(r"<(/?)div\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->|<(script|style)\b.*?</\3\s*>", re.S | re.I)
_ID = re.compile(r"\bid\s*=\s*[\"']?footer[\"'\s>]|\bid\s*=\s*[\"']?footer$", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?contentinfo(?:[\"'\s>]|$)", re.I)


def remove_footer(page: str) -> str:
    """Without the first ``div`` with the id ``footer`` and the role ``contentinfo``; other footers stay."""
    depth, start = 0, None
    for m in _DIV.finditer(page):
        if m[2] is None:
            continue
        if start is None:
            if not m[1] and _ID.search(m[2]) and _ROLE.search(m[2]):
                start, depth = m.start(), 1
        elif m[1]:
            depth -= 1
            if depth == 0:
                return page[:start] + page[m.end() :]
        else:
            depth += 1
    return page if start is None else page[:start]


@dataclass(frozen=True)
class Options:
    ignore_links: bool = False
    ignore_images: bool = False
    body_width: int = 0  # 0: lines aren't wrapped


class _Converter(HTMLParser):
    def __init__(self, options: Options):
        super().__init__(convert_charrefs=True)
        self.o, self.out, self.skip, self.pre = options, [], 0, 0
        self.lists: list[list] = []
        self.links: list[tuple[str, int]] = []
        self.quote = 0

    def say(self, text: str) -> None:
        self.out.append(text)

    def block(self) -> None:
        self.say("\n\n" + "> " * self.quote)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head", "title"):
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.block()
            self.say("#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "main", "header", "footer", "nav", "aside"):
            self.block()
        elif tag == "blockquote":
            self.quote += 1
            self.block()
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.say("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.say("\n" + "  " * max(1, len(self.lists)) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "br":
            self.say("  \n")
        elif tag == "hr":
            self.say("\n\n* * *\n\n")
        elif tag in ("b", "strong"):
            self.say("**")
        elif tag in ("i", "em"):
            self.say("_")
        elif tag == "pre":
            self.pre += 1
            self.say("\n\n```\n")
        elif tag in ("code", "tt") and not self.pre:
            self.say("`")
        elif tag == "img" and not self.o.ignore_images:
            self.say(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a" and not self.o.ignore_links:
            self.links.append((a.get("href") or "", len(self.out)))
            self.say("[")
        elif tag == "tr":
            self.say("\n")
        elif tag in ("td", "th"):
            self.say("| ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "title"):
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("b", "strong"):
            self.say("**")
        elif tag in ("i", "em"):
            self.say("_")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.say("\n```\n\n")
        elif tag in ("code", "tt") and not self.pre:
            self.say("`")
        elif tag == "a" and self.links:
            href, _ = self.links.pop()
            self.say(f"]({href})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.say("\n")
        elif tag == "blockquote":
            self.quote = max(0, self.quote - 1)
            self.say("\n\n")
        elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "table"):
            self.say("\n\n")
        elif tag in ("td", "th"):
            self.say(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.say(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(page: str, options: Options = Options()) -> str:
    c = _Converter(options)
    c.feed(page)
    c.close()
    text, fence, lines = "".join(c.out).replace("\xa0", " "), False, []
    for line in text.split("\n"):
        if line.startswith("```"):
            fence = not fence
        line = line if fence or line.endswith("  ") and line.strip() else line.rstrip()
        if not fence and options.body_width and len(line) > options.body_width and not line.lstrip().startswith(("|", "#", "```")):
            import textwrap

            lines += textwrap.wrap(line, options.body_width, break_long_words=False, break_on_hyphens=False)
        else:
            lines.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n" if text.strip() else ""


def footer_removed(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else remove_footer(p))

    return run(page)


def markdown(page: Column, options: Options = Options()) -> Column:
    """Footer removal and conversion in one crossing to Python."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else to_markdown(remove_footer(p), options))

    return run(page)


