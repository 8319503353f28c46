"""Query-log shapes: one text for all statements that differ in their values only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted text up to the next quote; a doubled quote ends one and begins the next. No group repeats, so that a long literal needs no recursion in the regex engine.
STRING_LITERAL = "'[^']*'"
NEIGHBOURS = r"\?\?+"
SHAPE_CHARS = 200


def normalise_shape(sql: Column) -> Column:
    """Literals, placeholders and numbers become ?, IN lists of any length one ?, white space one space; at most 200 characters."""
    out = F.regexp_replace(F.regexp_replace(sql, STRING_LITERAL, "?"), NEIGHBOURS, "?")
    out = F.regexp_replace(out, r"\$[0-9]+", "?")
    out = F.regexp_replace(out, r"\b[0-9]+(?:\.[0-9]+)?\b", "?")
    out = F.regexp_replace(out, r"(?i)\bin\s*\(\s*\?(?:\s*,\s*\?)*\s*\)", "IN (?)")
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    return F.substring(F.trim(out), 1, SHAPE_CHARS)
