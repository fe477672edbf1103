"""Texts of one repeated mark: every reader must stay near linear."""

import time

import pytest

from quillmere.llm import language, leaks, main_body, markup, near_duplicates, split
from quillmere.llm.html_tokens import read

MARKS = (
    "\\[", "\\(", "<div ", "<math>", "$$x", "[", "![", "**a ", "_a ", "`a", "{code", "{toc", "<pre", "<!--", "\\begin{equation}", "<li>a", "<div>a", "<script",
    '<a "', "&amp;", "    x\n", "# ", "a.", "```\n", "~~~\n", "> ", "| ", "{math}", "<h1>a", "<ul><li>", "'''a ", "x", "\\item ", "= a =\n", "-\n", "\n", " ",
)


@pytest.mark.parametrize("mark", MARKS)
def test_long(mark):
    text = mark * (100_000 // len(mark))
    began = time.process_time()
    markup.parse(text, render=True)
    main_body.units(read(text)[0])
    split.pieces(text)
    language.paragraphs(text)
    leaks.words(text)
    near_duplicates.shingles(text, 3)
    assert time.process_time() - began < 10
