"""Problem 4: splitting oversized items at natural boundaries.

Method: lexical-cohesion segmentation.  The text's words go through a pair of sliding blocks; where
the blocks on both sides share few words, the similarity curve has a valley, which marks a change of
topic.  The boundary level is the coarsest at which every unit fits; among its cuts in the second
half of each size window the one at the deepest valley is taken; then the end of a piece is repeated
at the start of the next one, as far as both stay under the limit.

Levels, coarsest first: section, paragraph, line, sentence, word; ``none`` where a single word
exceeds the limit, which is then cut at the limit.  The first two never cut inside a fenced block.

One pass over whole texts, without a shuffle but for files delivered again.

Defined cases: null ids, null texts and texts within the limit give no row; lengths are code points;
of a file delivered again the text ingested last counts (with equal times the greater text); white
space at the ends of a piece isn't part of it, and a text of white space only gives one empty
piece at the level ``section``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200
LEVELS = ("section", "paragraph", "line", "sentence", "word", "none")
#: Words a step and steps a block of the sliding comparison.
STEP, BLOCK = 20, 5

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_HEADING = re.compile(r"#{1,6} ")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _lines(text: str) -> tuple[list[tuple[int, str]], list[bool]]:
    """Lines with their offsets, and whether a cut before each is inside a fenced block."""
    lines = [(m.start(), m.group()) for m in _LINE.finditer(text)]
    inside = [False] * len(lines)
    marks: dict[str, list[int]] = {"```": [], "~~~": []}
    for k, (_, line) in enumerate(lines):
        if line[:3] in marks:
            marks[line[:3]].append(k)
    k = 0
    while k < len(lines):
        same = marks.get(lines[k][1][:3])
        after = bisect_right(same, k) if same else 0
        if same and after < len(same):
            for j in range(k + 1, same[after] + 1):
                inside[j] = True
            k = same[after]
        k += 1
    return lines, inside


def cuts(text: str, level: str) -> list[int]:
    """Offsets at which ``level`` may cut, without the ends."""
    rank = LEVELS.index(level)
    lines, inside = _lines(text)
    found = {at for (at, line), fenced in zip(lines, inside) if not fenced and _HEADING.match(line)}
    if rank >= 1:
        found |= {at for (at, line), fenced in zip(lines, inside) if not fenced and not line.strip()}
    if rank >= 2:
        found |= {at for at, _ in lines}
    if rank >= 3:
        found |= {m.end() for m in _SENTENCE.finditer(text)}
    if rank >= 4:
        found |= {m.end() for m in _SPACE.finditer(text)}
    return sorted(found - {0, len(text)})


def within(text: str, a: int, b: int, limit: int) -> bool:
    """Whether ``text[a:b]`` has at most ``limit`` code points without white space at its ends."""
    if b - a <= limit:
        return True
    while a < b and text[a].isspace():
        a += 1
    while b - a > limit and text[b - 1].isspace():
        b -= 1
    return b - a <= limit


def fits(text: str, at: list[int], limit: int) -> bool:
    ends = [0, *at, len(text)]
    return all(within(text, a, b, limit) for a, b in zip(ends, ends[1:]))


def boundary(text: str, limit: int = LIMIT) -> str:
    """The coarsest level at which every unit fits."""
    return next((level for level in LEVELS[:-1] if fits(text, cuts(text, level), limit)), "none")


def depths(text: str) -> tuple[list[int], list[float]]:
    """Offsets between steps of words, and how deep the valley of similarity is there."""
    words = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
    steps = [Counter(w for _, w in words[k : k + STEP]) for k in range(0, len(words), STEP)]
    if len(steps) < 2:
        return [], []
    left, right, likeness = Counter(), Counter(), []
    for c in steps[: BLOCK]:
        right.update(c)
    for gap in range(1, len(steps)):
        left.update(steps[gap - 1])
        right.subtract(steps[gap - 1])
        if gap > BLOCK:
            left.subtract(steps[gap - 1 - BLOCK])
        if gap + BLOCK - 1 < len(steps):
            right.update(steps[gap + BLOCK - 1])
        dot = sum(n * right[w] for w, n in left.items() if n and w in right)
        size = (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5
        likeness.append(dot / size if size else 0.0)
        if gap % 50 == 0:
            left, right = +left, +right
    n = len(likeness)
    before, after = likeness[:], likeness[:]  # the peaks on both sides
    for k in range(1, n):
        before[k] = max(likeness[k], before[k - 1]) if likeness[k - 1] >= likeness[k] else likeness[k]
    for k in range(n - 2, -1, -1):
        after[k] = max(likeness[k], after[k + 1]) if likeness[k + 1] >= likeness[k] else likeness[k]
    return [words[(k + 1) * STEP][0] for k in range(n)], [before[k] + after[k] - 2 * likeness[k] for k in range(n)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int]]]:
    """The level, and the pieces' offsets (white space at their ends aside)."""
    level = boundary(text, limit)
    at = cuts(text, level)
    if level == "none":
        ends, more = [0, *at, len(text)], []
        for a, b in zip(ends, ends[1:]):
            more += range(a + limit, b, limit)
        at = sorted({*at, *more})
    at.append(len(text))
    gaps, depth = depths(text)
    found, start, cut, k, gap = [], 0, 0, 0, 0

    def room(a: int, b: int) -> bool:
        return within(text, a, b, limit)

    while cut < len(text):
        if room(start, len(text)):
            found.append((start, len(text)))
            break
        fit = k
        while fit + 1 < len(at) and room(start, at[fit + 1]):
            fit += 1
        best, deepest, near = fit, -1.0, gap
        for c in range(k, fit + 1):
            if at[c] - start < limit // 2 and c != fit:
                continue
            while near + 1 < len(gaps) and abs(gaps[near + 1] - at[c]) <= abs(gaps[near] - at[c]):
                near += 1
            d = depth[near] if gaps and abs(gaps[near] - at[c]) <= 2 * STEP * 8 else 0.0
            if d >= deepest:
                best, deepest = c, d
        cut, gap = at[best], near
        found.append((start, cut))
        k = best + 1
        if k >= len(at):
            break
        start = cut
        for m in _SPACE.finditer(text, max(0, cut - overlap), cut):
            if m.end() < cut and room(m.end(), at[k]):
                start = m.end()
                break
    out = []
    for a, b in found:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            out.append((a + lead, a + len(part.rstrip())))
    return level, out or [(0, 0)]


def _rows(files: DataFrame, id_col: str, text_col: str, order_col: str | None, limit: int) -> DataFrame:
    when = F.coalesce(F.unix_micros(F.col(order_col).cast("timestamp")), F.lit(0)) if order_col else F.lit(0)
    rows = files.select(F.col(id_col).cast("long").alias("file_id"), when.cast("long").alias("ingested"), F.col(text_col).cast("string").alias("text"))
    return rows.where((F.length("text") > limit) & F.col("file_id").isNotNull())


def split(
    files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "file_id", text_col: str = "content", order_col: str | None = "ingested_at"
) -> DataFrame:
    """(file_id, piece_no, boundary, first, last, text): code points first..last of each piece, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                level, parts = pieces(text, limit, overlap)
                out += [(file, n, level, a + 1, b, text[a:b]) for n, (a, b) in enumerate(parts, 1)]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["file_id", "piece_no", "boundary", "first", "last", "text"]
            )

    last = _rows(files, id_col, text_col, order_col, limit).groupBy("file_id").agg(F.max(F.struct("ingested", "text")).alias("x"))
    return last.select("file_id", F.col("x.text").alias("text")).mapInArrow(
        run, "file_id bigint, piece_no bigint, boundary string, first bigint, last bigint, text string"
    )


def found(files: DataFrame) -> DataFrame:
    """(file_id, boundary) of the files over the limit."""
    return split(files).where("piece_no = 1").select("file_id", "boundary")
