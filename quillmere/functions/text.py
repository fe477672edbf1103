"""Regular-expression helpers that give Java's engine the line and white-space rules of Unicode text.

``(?d)`` makes only a line feed end a line; ``WS`` is every Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at both ends; ``trim`` knows only the blank."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def quote_replacement(value: Column) -> Column:
    """A value that may stand as replacement in ``regexp_replace``."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
