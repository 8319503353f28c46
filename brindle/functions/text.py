"""Lines, quotes and containment in source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_CHARS = 24
CONTAINED_SHARE = 0.7
TOKEN_CHARS = 3.6

# What a description of a measurement has to name, and how it is recognised.
DIMENSIONS = (("rows", r"(?i)\brows?\b|\bresult set\b|\bmatches\b"), ("columns", r"(?i)\bcolumns?\b|\bprojection\b|\bfields?\b|\bselect list\b"), ("order", r"(?i)\border\b|\bordering\b|\bsort"), ("duplicates", r"(?i)\bnull\b|\bduplicat"))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(TOKEN_CHARS)).cast("long")


def plain(text: Column) -> Column:
    """Lower case, without quotes, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[\"'`]", ""), r"[ \t\r\n]+", " "))


def contains_loosely(text: Column, quote: Column, window: int = WINDOW_CHARS, share: float = CONTAINED_SHARE) -> Column:
    """Whether text holds quote up to case, quotes and white space; of a quote of a window or more, enough of its whole consecutive windows. An empty quote stands everywhere."""
    h, q = plain(text), plain(quote)
    starts = F.sequence(F.lit(0), F.length(q) - window, F.lit(window))
    windows = F.transform(starts, lambda i: F.substring(q, i + 1, F.lit(window)))
    found = F.size(F.filter(windows, lambda w: F.contains(h, w)))
    return (F.trim(quote) == "") | F.contains(h, q) | F.when(F.length(q) >= window, found >= share * F.size(windows)).otherwise(False)


def missing_dimensions(text: Column) -> Column:
    return F.filter(F.array(*[F.when(~text.rlike(p), F.lit(n)) for n, p in DIMENSIONS]), lambda n: n.isNotNull())


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, 1-based and inclusive; places outside the text are left out."""
    lines = F.split(text, "\n", -1)
    low, high = F.greatest(F.lit(1), first), F.least(F.size(lines), last)
    return F.when(high >= low, F.array_join(F.slice(lines, low, high - low + 1), "\n")).otherwise("")


def first_significant_line(text: Column) -> Column:
    """The first line of more than eight characters, without a line number in front; without one, the text's first forty characters."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s*[0-9]+\s*\|\s?", "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) > 8), F.lit(0)), F.left(text, F.lit(40)))


def mask_key(key: Column) -> Column:
    """The ends of a secret, the rest starred."""
    return F.when(F.length(key) <= 8, F.repeat(F.lit("*"), F.length(key))).otherwise(F.concat(F.left(key, F.lit(4)), F.repeat(F.lit("*"), F.length(key) - 8), F.right(key, F.lit(4))))


def percent(share: Column) -> Column:
    """A share as whole percent; a dash for what is unknown."""
    return F.coalesce(F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%")), F.lit("–"))


def dollars(amount: Column) -> Column:
    """An amount with two decimals, less than a cent as such."""
    return F.when((amount > 0) & (amount < 0.01), "<$0.01").otherwise(F.concat(F.lit("$"), F.format_number(amount, 2)))


def milliseconds(ms: Column) -> Column:
    """A time with one decimal."""
    return F.when(ms.isNull(), F.lit("unknown")).otherwise(F.concat(F.format_string("%.1f", ms), F.lit("ms")))
