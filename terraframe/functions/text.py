"""Columns for strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def hex_color(c: Column) -> Column:
    """#RRGGBB or #RRGGBBAA in upper case from 3, 4, 6 or 8 digits with or without #; else null."""
    digits = F.upper(F.regexp_replace(F.trim(c), "^#", ""))
    doubled = F.regexp_replace(digits, "(.)", "$1$1")
    ok = digits.rlike("^[0-9A-F]+$")
    return F.when(ok & F.length(digits).isin(3, 4), F.concat(F.lit("#"), doubled)).when(ok & F.length(digits).isin(6, 8), F.concat(F.lit("#"), digits))


def number(c: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def boolean(c: Column) -> Column:
    return F.when(c.isin("yes", "true", "1"), True).when(c.isin("no", "false", "0"), False)


def sentence_case(c: Column) -> Column:
    """camelCase as words in lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "([A-Z])", " $1")))


def feature_id(c: Column) -> Column:
    """The whole number that an id begins with, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")


def collapsed(c: Column) -> Column:
    """Trimmed, with runs of white space as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
