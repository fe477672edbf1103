"""Markdown cleaning as column expressions; null in, null out.  All stay inside code generation.

The headings, file names and repetition counts in the patterns are fixed values of the format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions.text import WS, strip


def from_first_header(text: Column) -> Column:
    """Drops what stands above the first line that starts with ``#``."""
    return F.regexp_replace(text, rf"(?s)\A.*?(?=(?md:^){WS}*#)", "")


def without_attachments(text: Column) -> Column:
    """Drops the attachments section and blanks lines with inline attachments."""
    cut = F.regexp_replace(text, r"\n## Attachments:(?s:.*)", "")
    return F.regexp_replace(cut, r"(?md)^.*!\[.*?\]\(attachments/.*?\).*$", "")


def without_trailing_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)[ \t]+$", "")


def fenced(text: Column) -> Column:
    """Puts a fence round each run of lines indented by four blanks; the possessive groups don't recurse."""
    return F.regexp_replace(text, r"(?md)((?:^ {4}.*\n)++(?:^\s*\n(?:^ {4}.*\n)++)*+)", "```\n$1```\n")


def fewer_breaks(text: Column) -> Column:
    """Three or more line ends in a row become two."""
    return F.regexp_replace(text, r"\n[ \t]*\n[ \t]*\n[ \t\n]*", "\n\n")


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)!\[.*\]\(.*\)", "")


def clean(text: Column) -> Column:
    return strip(fewer_breaks(fenced(without_trailing_blanks(without_attachments(from_first_header(text))))))


def prepare(text: Column) -> Column:
    """The text that is embedded or sent to a model."""
    return strip(without_images(fewer_breaks(without_trailing_blanks(without_attachments(text)))))
