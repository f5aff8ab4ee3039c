"""Column expressions that bring the notations of dirty finding tables to one form.

All are built-in expressions (no Python workers) and map what they cannot read to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINGERPRINT = r"^\s*(?:sha256:|0x)?([0-9a-f]{16})(?:[0-9a-f]{48})?\s*$"
COMMIT = r"^\s*(?:\S*-g)?([0-9a-f]{7,40})\s*$"
CWE = r"(?i)^\s*(?:cwe)?[\s_:-]*0*([1-9][0-9]*)\b"
SOURCE_LINE = r"(?md)^[ \t]*(?:>>>)?[ \t]*[0-9]+ \|"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def word(col: Column) -> Column:
    """An enumeration value without letter case and outer blanks; blank is null."""
    return _or_null(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")))


def fingerprint(col: Column) -> Column:
    """16 hex digits in lower case; a stand-in of one repeated digit (all 0, all f) is none."""
    hexed = F.regexp_extract(F.lower(col), FINGERPRINT, 1)
    return F.when((hexed != "") & ~hexed.isin("0" * 16, "f" * 16), hexed)


def commit(col: Column) -> Column:
    """The hash, whole or abbreviated, also out of a tag description ending in -g<hash>."""
    return _or_null(F.regexp_extract(F.lower(col), COMMIT, 1))


def same_commit(a: Column, b: Column) -> Column:
    """True if one hash abbreviates the other; a missing hash equals none."""
    return F.coalesce(F.startswith(a, b) | F.startswith(b, a), F.lit(False))


def share(col: Column) -> Column:
    """A confidence as a share of one; values above one are percent, others out of range are null."""
    return F.when(col.between(0.0, 1.0), col).when((col > 1.0) & (col <= 100.0), col / 100.0)


def cwe_number(col: Column) -> Column:
    """The number in any notation of a weakness (CWE-120, cwe_0120, 120, 'CWE-120: text')."""
    return F.regexp_extract(col, CWE, 1).try_cast("int")


def cwe(col: Column) -> Column:
    number = cwe_number(col)
    return F.when(number.isNotNull(), F.concat(F.lit("CWE-"), number.cast("string")))


def tool_list(col: Column) -> Column:
    """The different tools of a list written with commas, semicolons or as JSON; null gives an empty list."""
    bare = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r'[\[\]"\']', "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(bare, r"[,;]"), lambda t: F.trim(t)), lambda t: t != "")))


def source_lines(col: Column) -> Column:
    """How many lines of a snippet are numbered source lines; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(SOURCE_LINE)), F.lit(0))


def posix_path(col: Column) -> Column:
    """Forward slashes, no doubled slashes, no '.' steps, 'x/..' steps resolved however many there are."""
    path = F.regexp_replace(F.trim(col), r"\\", "/")
    path = F.regexp_replace(path, r"(?i)^file://+", "/")
    path = F.regexp_replace(path, r"/(?:\./|/)+", "/")
    path = F.regexp_replace(path, r"^(?:\./)+", "")
    up = lambda done, step: (step == "..") & ~F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")).isin("", "..")
    walk = lambda done, step: F.when(up(done, step), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step)))
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), walk)
    return _or_null(F.when(F.contains(path, F.lit("/..")), F.array_join(steps, "/")).otherwise(path))
