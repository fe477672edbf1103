"""Prompts for category tagging, and reading of the answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions.text import strip

SYSTEM = "You name the categories that a document belongs to."
NONE_FOUND = "No categories found."


def user_message(prepared: Column) -> Column:
    return F.concat(
        F.lit('Name the categories of the following document. Answer as """Categories: first, second""".\n```markdown\n'), prepared, F.lit("\n```")
    )


def messages(system: Column, user: Column) -> Column:
    """Chat messages; an empty or null system text is left out."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.filter(F.array(one("system", system), one("user", user)), lambda m: (m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""))


def quoted_parts(message: Column) -> Column:
    """The stripped contents of all parts in triple quotes or fences."""
    found = F.regexp_extract_all(message, F.lit(r'(?s)""".*?"""|```.*?```'), 0)
    return F.transform(found, lambda x: strip(F.substr(x, F.lit(4), F.length(x) - 6)))


def output_lines(filename: Column, message: Column) -> Column:
    """One line a part, or one that says that there is none."""
    parts = quoted_parts(message)
    return F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(NONE_FOUND))), lambda x: F.concat(F.lit("Filename: "), filename, F.lit(" | "), x))


def distinct_categories(text: Column) -> Column:
    """Sorted distinct categories of an output file; one empty category where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?d)\| Categories: (.+?)\n"), 1)
    return F.array_sort(F.array_distinct(F.split(F.array_join(found, ", "), ", ", -1)))
