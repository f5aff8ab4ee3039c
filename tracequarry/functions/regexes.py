"""Regular expressions in Spark with the meaning that the patterns have elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_words(pattern: str) -> str:
    """With word boundaries between ASCII words; Java's own take the letters of all scripts for words.

    A boundary before a name, a group of names or [A-Za-z is a plain look-behind.
    """
    pattern = re.sub(r"\\b(?=[A-Za-z_(]|\[A-Za-z|\\w)", lambda _: r"(?<!\w)", pattern)
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def java(pattern: str) -> str:
    """The pattern for Java: only a line feed ends a line, words are ASCII, and repeated groups run without recursion.

    A possessive group is matched in a loop; a plain one takes stack for every repetition and
    fails on very long lines. Nothing that follows one here could match within it.
    """
    return "(?d)" + ascii_words(pattern).replace(r"\\.)*", r"\\.)*+").replace("){3,}", "){3,}+")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def _joined(parts: tuple[str | Column, ...]) -> Column:
    return F.concat(F.lit("(?d)"), *[F.lit(ascii_words(p)) if isinstance(p, str) else p for p in parts])


def has_dynamic(text: Column, *parts: str | Column) -> Column:
    """Whether the text has a pattern that is put together from constants and words of the row."""
    return F.regexp_like(text, _joined(parts))


def every_dynamic(text: Column, group: int, *parts: str | Column) -> Column:
    """A group of all matches of such a pattern."""
    return F.regexp_extract_all(text, _joined(parts), F.lit(group))


def extract_dynamic(text: Column, group: int, *parts: str | Column) -> Column:
    """A group of the first match of such a pattern; empty for none."""
    return F.call_function("regexp_extract", text, _joined(parts), F.lit(group))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; empty for none."""
    return F.regexp_extract(text, java(pattern), group)


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def after(text: Column, pattern: str) -> Column:
    """What follows the first match; the pattern has one group at most."""
    groups = 2 if "(" in pattern.replace(r"\(", "").replace("(?", "") else 1
    return F.regexp_extract(text, java("(?s)") + pattern + "(.*)$", groups)


def strip_comments(text: Column) -> Column:
    """Without block comments, string contents and line comments."""
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    text = F.regexp_replace(text, r"'(?:[^'\\]|\\.)*+'", "''")
    return F.regexp_replace(text, r"(?d)//.*", "")
