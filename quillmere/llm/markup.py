"""Reading of mixed Markdown, wiki, LaTeX and HTML markup into clean text with its structural elements.

Elements are ``heading``, ``list_item``, ``code_block`` and ``formula``.  Comments, leading page data
and attachments sections hold none; markup inside a code block is content.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

KINDS = ("heading", "list_item", "code_block", "formula")

#: Comments and code, whichever opens first; what stands inside belongs to it.
_OPAQUE = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<fence>`{3,}|~{3,})[^\n`]*\n(?P<fenced>.*?)(?:^[ ]{0,3}(?:>[ ]?)*(?P=fence)[`~]*[ \t]*$|\Z)"
    r"|<pre\b[^<>]*>(?P<pre>.*?)(?:</pre\s*>|\Z)"
    r"|<(?P<high>syntaxhighlight|source)\b[^<>]*>(?P<highlit>.*?)(?:</(?P=high)\s*>|\Z)"
    r"|\{code(?::[^}\n]*)?\}(?P<code>.*?)(?:\{code\}|\Z)"
    r"|\{noformat(?::[^}\n]*)?\}(?P<noformat>.*?)(?:\{noformat\}|\Z)"
    r"|\\begin\{(?P<env>verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]\n]*\])?(?P<verb>.*?)(?:\\end\{(?P=env)\*?\}|\Z)"
    r"|(?P<inline>(?<![`\\])`[^`\n]+`(?!`))",
    re.S | re.M | re.I,
)
_LINE_START = re.compile(r"[ ]{0,3}(?:>[ ]?)*\Z")
_OPAQUE_TRIGGER = re.compile(r"<(?=!--|pre\b|syntaxhighlight\b|source\b)|\{(?=code|noformat)|\\(?=begin\{)|`|~(?=~~)", re.I)
_FORMULA_TRIGGER = re.compile(r"<(?=math\b|div\b|span\b)|\{(?=math)|\\(?=[\[(b])|\$", re.I)
_FRONT = re.compile(r"\A\s*(?:---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z))", re.S)
_MADE_BY = re.compile(r"\A\s*Created by [^\n]*(?:\n|\Z)")
_ATTACHED = re.compile(
    r"^[ \t]*(?:#{1,6}[ \t]+|h[1-6]\.[ \t]+|={1,6}[ \t]*|<h[1-6][^>]*>\s*|\\(?:sub)*section\*?\{)Attachments:?[^\n]*", re.M | re.I
)
_FORMULA = re.compile(
    r"<(?P<tag>math)\b[^<>]*>(?P<m1>.*?)</math\s*>"
    r"|<(?P<holder>div|span)\b[^<>]*\bclass=[\"']math[\"'][^<>]*>(?P<m2>.*?)</(?P=holder)\s*>"
    r"|\{(?P<macro>mathinline|mathblock|math)(?::[^}\n]*)?\}(?P<m3>.*?)\{(?P=macro)\}"
    r"|\\begin\{(?P<env>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}(?P<m4>.*?)\\end\{(?P=env)(?P=star)\}"
    r"|(?<!\\)\$\$(?P<m5>.+?)(?<!\\)\$\$"
    r"|(?<!\\)\\\[(?P<m6>.+?)\\\]"
    r"|(?<!\\)\\\((?P<m7>.+?)\\\)"
    r"|(?<![\\$])\$(?=[^\s$])(?P<m8>[^$\n]*?[^\s$\\])\$(?![\d$])",
    re.S | re.I,
)
_HOLE = re.compile(r"\ue000(\d+)\ue001")
_ATX = re.compile(r"[ ]{0,3}#{1,6}[ \t]+\S")
_WIKI_H = re.compile(r"[ ]{0,3}h([1-6])\.[ \t]+\S")
_EQUALS = re.compile(r"[ ]{0,3}(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
_SETEXT = re.compile(r"[ ]{0,3}(?:={2,}|-{2,})[ \t]*$")
_UNDER, _MARKS = frozenset(" =-"), frozenset("-*_+#|{")
_BULLET = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)")
_WIKI_LIST = re.compile(r"[ \t]*(?:[*#]+|-+)[ \t]+(?=\S)")
_TEX_H = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{")
_TEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[[^\]\n]*\])?")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_RULE = re.compile(r"[ ]{0,3}(?:[-*_][ \t]*){3,}$")
_QUOTE = re.compile(r"^[ ]{0,3}(?:>[ ]?)+")
_BOX = re.compile(r"\[[ xX]\][ ]")
_IN_LINE = re.compile(rf"({_TEX_H.pattern})|({_TEX_ITEM.pattern})|(<h[1-6]\b[^>]*>)|(<li\b[^>]*>)", re.I)
_ENDS = re.compile(r"</(?:h[1-6]|li)\s*>|<li\b|<[uo]l\b|\}(?=\\label|\s*$)", re.I)
_TEX_LAYOUT = re.compile(
    r"\\(?:begin|end)\{[^}\n]*\}(?:\{[^}\n]*\})?|\\(?:vspace|hspace|newpage|maketitle|tableofcontents|centering)\b(?:\{[^}\n]*\})?|\\\\$"
)
_OPEN_H, _OPEN_LI = re.compile(r"<h[1-6]\b[^>]*>", re.I), re.compile(r"<li\b[^>]*>", re.I)
_CELL, _ROW = re.compile(r"</t[dh]\s*>\s*(?=<t[dh]\b)", re.I), re.compile(r"</tr\s*>\s*(?=<tr\b)", re.I)
_TEX_COMMENT = re.compile(r"(?m)^[ \t]*%[^\n]*\n?")


@dataclass
class Parsed:
    """The elements in the order of the text, as (kind, text), and the clean text."""

    elements: list[tuple[str, str]] = field(default_factory=list)
    text: str = ""

    def counts(self) -> dict[str, int]:
        found = dict.fromkeys(KINDS, 0)
        for kind, _ in self.elements:
            found[kind] += 1
        return found


def is_attachments(line: str) -> bool:
    return bool(_ATTACHED.match(line))


_TEX_STYLE = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|mbox|label|url)\{([^{}]*)\}")
_IMAGE = re.compile(r"\[?!\[[^\[\]\n]*\]\([^()\n]*\)(?:\]\([^()\n]*\))?")
_LINK = re.compile(r"\[([^\[\]\n|]+)\]\([^()\n]*\)")
_WIKI_LINK = re.compile(r"\[([^\[\]\n|]+)\|[^\[\]\n]+\]")
_MEDIA_LINK = re.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]*)\]\]|\[https?://[^\s\[\]]+[ ]([^\[\]\n]+)\]")
_MACRO = re.compile(r"\{(?:toc|anchor|info|note|warning|tip|panel|color|quote|expand|section|column|status)[^{}\n]*\}|\{\{[A-Z][^{}\n]*\|[^{}\n]*\}\}|\[\[Category:[^\[\]\n]*\]\]")
_STRESS = re.compile(r"(\*\*|__|''')(?=\S)(.{1,1000}?)(?<=\S)\1|(?<![\w*])([*_])(?=[^\s*_])([^\n*_]{1,1000}?)(?<=\S)\3(?![\w*])")
_ESCAPE = re.compile(r"\\([\\`*_{}\[\]()#+\-.!$%&|~])")


def inline(line: str) -> str:
    """A line without inline markup."""
    if "{" in line or "[" in line:
        line = _MACRO.sub("", _IMAGE.sub("", line))
    if "[" in line:
        line = _LINK.sub(r"\1", line)
        line = _MEDIA_LINK.sub(lambda m: m[1] or m[2] or "", line)
        line = _WIKI_LINK.sub(r"\1", line)
    if "\\" in line:
        line = _TEX_STYLE.sub(lambda m: "" if m[0].startswith("\\label") else m[1], line)
    if "*" in line or "_" in line or "'''" in line:
        line = _STRESS.sub(lambda m: m[2] or m[4], line)
    if "<" in line:
        line = _TAG.sub("", line)
    if "&" in line:
        line = html.unescape(line)
    if "\\" in line:
        line = _ESCAPE.sub(r"\1", line)
    return line.replace("\xa0", " ").strip()


#: What must follow an opening mark for a formula to be there at all; without it later openings needn't be tried.
_CLOSERS = (
    (re.compile(r"<math", re.I), "</math"), (re.compile(r"<div", re.I), "</div"), (re.compile(r"<span", re.I), "</span"), (re.compile(r"\{math", re.I), "{math"),
    (re.compile(r"\\begin"), "\\end{"), (re.compile(r"\\\["), "\\]"), (re.compile(r"\\\("), "\\)"), (re.compile(r"\$\$"), "$$"),
)


def _closes(text: str, low: str, p: int, gone: set[str]) -> bool:
    for opens, closer in _CLOSERS:
        if opens.match(text, p):
            if closer not in gone and low.find(closer, p + 2) < 0:
                gone.add(closer)
            return closer not in gone
    return True


def _replace(text: str, triggers: re.Pattern, pattern: re.Pattern, change) -> str:
    """``pattern.sub`` for a pattern whose matches all begin with one of ``triggers``: it is tried there only."""
    out, at, gone, low = [], 0, set(), text.lower() if pattern is _FORMULA else ""
    if len(low) != len(text):
        low = text  # letters whose lower case is longer
    for m in triggers.finditer(text):
        p = m.start()
        if p < at or pattern is _FORMULA and not _closes(text, low, p, gone):
            continue
        hit, before = None, text[at:p]
        if pattern is _OPAQUE and text[p] in "`~":
            start = text.rfind("\n", 0, p) + 1
            if text.startswith(("```", "~~~"), p):
                if _LINE_START.fullmatch(text[start:p]) and start >= at:
                    hit, before = pattern.match(text, p), text[at:start]
                    if hit is not None and hit["fence"] is None:
                        hit, before = None, text[at:p]
            elif text[p] == "`":
                hit = pattern.match(text, p)
        else:
            hit = pattern.match(text, p)
        if hit is not None:
            out += [before, change(hit)]
            at = hit.end()
    return "".join([*out, text[at:]]) if out else text


def parse(text: str, render: bool = False, words_only: bool = False) -> Parsed:
    """The structure of a text in any of the markups, or a mixture; ``render`` asks for the clean text too, ``words_only`` for it
    without code and formulas."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _FRONT.sub("", text, count=1)
    text = _MADE_BY.sub("", text, count=1)
    holes: list[tuple[str, str]] = []

    def hole(kind: str, content: str, block: bool) -> str:
        holes.append((kind, content))
        mark = f"\ue000{len(holes) - 1}\ue001"
        return f"\n{mark}\n" if block else mark

    def opaque(m: re.Match) -> str:
        if m["comment"] is not None:
            return ""
        if m["inline"] is not None:
            return hole("inline", m["inline"].strip("`"), False)
        content = next(c for c in (m["fenced"], m["pre"], m["highlit"], m["code"], m["noformat"], m["verb"]) if c is not None)
        if m["pre"] is not None:
            content = html.unescape(_TAG.sub("", content))
        return hole("code_block", content.strip("\n"), True)

    tex = "\\begin{" in text or bool(_TEX_H.search(text))
    text = _replace(text, _OPAQUE_TRIGGER, _OPAQUE, opaque)
    if tex:
        text = _TEX_COMMENT.sub("", text)
    attached = _ATTACHED.search(text)
    if attached:
        after = text[attached.end() :]
        ends = re.search(r"^[ ]{0,3}(?:#{1,6}[ \t]+\S|h[1-6]\.[ \t]+\S|={1,6}[ \t]*\w[^\n]*=[ \t]*$|<h[1-6]\b)|^\\(?:sub)*section", after, re.M)
        text = text[: attached.start()] + (after[ends.start() :] if ends else "")

    def formula(m: re.Match) -> str:
        content = next(c for c in m.group("m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8") if c is not None)
        if m["m1"] is not None or m["m2"] is not None:
            content = html.unescape(_TAG.sub("", content))
            content = re.sub(r"^\s*(?:\$\$|\\\[|\\\(|\$)\s*|\s*(?:\$\$|\\\]|\\\)|\$)\s*$", "", content)
        return hole("formula", content.strip(), False)

    text = _replace(text, _FORMULA_TRIGGER, _FORMULA, formula)
    lines = text.split("\n")
    wiki: bool | None = None  # where a run of # lines is a list; asked only there

    def is_wiki() -> bool:
        jira = sum(1 for x in lines if _WIKI_H.match(x))
        media = sum(1 for x in lines if _EQUALS.match(x)) + 2 * text.count("{|")
        return jira + media > sum(1 for x in lines if _ATX.match(x))

    parsed = Parsed()
    out: list[str] = []
    add = parsed.elements.append

    def fill(line: str) -> str:
        """Puts code and formulas back, as elements of their own; running text goes without them."""
        if "\ue000" not in line:
            return inline(line) if render else ""
        shown, at = [], 0
        for m in _HOLE.finditer(line):
            kind, content = holes[int(m[1])]
            shown.append(inline(line[at : m.start()]))
            at = m.end()
            if kind != "inline":
                add((kind, content))
            if words_only:
                shown.append(" ")
            else:
                shown.append(f"\n```\n{content}\n```\n" if kind == "code_block" else f" `{content}` " if kind == "inline" else f" ${content}$ ")
        shown.append(inline(line[at:]))
        return "".join(shown).strip(" ")

    blank, in_code, last_list = True, None, False
    k = 0
    while k < len(lines):
        line = lines[k]
        body = _QUOTE.sub("", line) if ">" in line else line
        if not body.strip():
            blank = True
            out.append("")
            k += 1
            continue
        if blank and line.startswith(("    ", "\t")) and not _TEX_ITEM.match(line.strip()):
            code = []
            while k < len(lines) and (lines[k].startswith(("    ", "\t")) or not lines[k].strip()):
                code.append(lines[k][4:] if lines[k].startswith("    ") else lines[k].lstrip("\t"))
                k += 1
            back = _HOLE.sub(lambda m: holes[int(m[1])][1], "\n".join(code)).strip("\n")
            add(("code_block", back))
            if not words_only:
                out += ["```", back, "```", ""]
            continue
        following = lines[k + 1] if k + 1 < len(lines) else ""
        first, heading = body.lstrip()[0], None  # a pattern is tried only where it can match
        listed = first == "#" and (following.startswith("# ") or (k and lines[k - 1].startswith("# ")))
        if listed and wiki is None:
            wiki = is_wiki()
        if first == "h" and (m := _WIKI_H.match(body)):
            heading = body[m.end() - 1 :]
        elif first == "=" and (m := _EQUALS.match(body)):
            heading = m[2]
        elif first == "#" and _ATX.match(body) and not (wiki and listed):
            heading = re.sub(r"[ \t]#+[ \t]*$", "", body.strip().lstrip("#"))
        elif (
            following[:1] in _UNDER
            and _SETEXT.match(following)
            and not _BULLET.match(body)
            and not body.lstrip().startswith(("|", "<", "{", "\\"))
            and not _SETEXT.match(body)
            and not _HOLE.fullmatch(body.strip())
            and blank
        ):
            heading = body
            k += 1
        if heading is not None:
            shown = fill(heading)
            add(("heading", shown))
            out += ["", "# " + shown, ""]
            k, blank = k + 1, True
            continue
        blank = False
        if first in _MARKS and (_RULE.match(body) or body.lstrip().startswith(("|-", "{|", "|}"))):
            k += 1
            continue
        item = (first in _MARKS or first.isdecimal()) and (_BULLET.match(body) or _WIKI_LIST.match(body))
        if item:
            rest = body[item.end() :]
            if rest[:1] == "[":
                rest = _BOX.sub("", rest)
            shown = fill(rest)
            add(("list_item", shown))
            out.append("- " + shown)
            k += 1
            continue
        # elements that may stand inside a line
        if "\\" in body or "<" in body:
            inside = list(_IN_LINE.finditer(body))
            for m, after in zip(inside, [*(x.start() for x in inside[1:]), len(body)]):
                stop = _ENDS.search(body, m.end(), after)
                shown = inline(_HOLE.sub("", body[m.end() : stop.start() if stop else after]))
                add(("heading" if m[1] or m[3] else "list_item", shown))
            if render and "\\" in body:
                body = _TEX_ITEM.sub("- ", _TEX_LAYOUT.sub("", _TEX_H.sub("# ", body)))
            if render and "<" in body:
                body = _ROW.sub(" / ", _CELL.sub(" | ", _OPEN_LI.sub("- ", _OPEN_H.sub("# ", body))))
        if first in "|\\<" and body.lstrip().startswith("|"):  # or what was taken away stood before it
            body = re.sub(r"\s*\|+\s*", " | ", body.strip()).strip(" |")
        shown = fill(body.removesuffix("}") if body.startswith("# ") and tex else body)
        if shown:
            out.append(shown)
        k += 1
    if render:
        parsed.text = "\n".join(out) if words_only else re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
    return parsed
