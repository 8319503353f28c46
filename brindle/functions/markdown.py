"""Markdown of reports as HTML: headings, fences, tables, lists, quotes, rules and inline marks, by one fold over the lines. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE, _LIST, _TABLE, _NONE = "code", "list", "table", ""
_OPENS = {_CODE: "<pre><code>", _LIST: "<ul>", _TABLE: "<table>"}
_CLOSES = {_CODE: "</code></pre>", _LIST: "</ul>", _TABLE: "</table>"}
#: Headings of one to four marks; the line between a table's head and its body.
_HEADING, _TABLE_RULE = r"^(#{1,4})\s+(.*)$", r"^\|[\s|:-]+\|$"
STYLE = "body{max-width:54em;margin:2em auto;padding:0 1em;font:1em/1.6 sans-serif}pre{padding:1em;overflow-x:auto;background:#8881}table{width:100%;border-collapse:collapse}td{padding:.3em .8em;border-bottom:1px solid #8884}blockquote{margin:1em 0;padding:.5em 1em;border-left:3px solid #888}@media print{h3{page-break-inside:avoid}}"


def escaped(text: Column) -> Column:
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = F.replace(text, F.lit(c), F.lit(f"&{name};"))
    return text


def inline(text: Column) -> Column:
    """A line's text with its code, strong and emphasised parts marked."""
    for pattern, tag in ((r"`([^`]+)`", "code"), (r"\*\*([^*]+)\*\*", "strong"), (r"_([^_]+)_", "em")):
        text = F.regexp_replace(text if pattern[0] != "`" else escaped(text), pattern, f"<{tag}>$1</{tag}>")
    return text


def _kind(line: Column) -> Column:
    """What a line outside of fences is."""
    return (
        F.when(line.startswith("```"), _CODE).when(line.rlike(_TABLE_RULE), "rule").when(line.startswith("|"), _TABLE).when(line.rlike(_HEADING), "heading").when(line.startswith("> "), "quote")
        .when(line.startswith("- "), _LIST).when(F.trim(line) == "---", "line").when(F.trim(line) == "", "blank").otherwise("text")
    )


def _cells(line: Column) -> Column:
    parts = F.split(line, r"\|", -1)
    return F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.concat(F.lit("<td>"), inline(F.trim(c)), F.lit("</td>"))), "")


def _told(line: Column, kind: Column) -> Column:
    """A line's own HTML; null for one that has none."""
    wrapped = lambda tag, text: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))
    rest = F.substring(line, 3, 1 << 30)
    level = F.length(F.regexp_extract(line, _HEADING, 1)).cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(">"), inline(F.regexp_extract(line, _HEADING, 2)), F.lit("</h"), level, F.lit(">"))
    return F.when(kind == _TABLE, wrapped("tr", _cells(line))).when(kind == "heading", heading).when(kind == "quote", wrapped("blockquote", inline(rest))).when(kind == _LIST, wrapped("li", inline(rest))).when(kind == "line", "<hr>").when(kind == "text", wrapped("p", inline(line)))


def _choice(state: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(state == s, F.lit(tag)) for s, tag in table.items()])


def html(markdown: Column) -> Column:
    """The HTML of a markdown text, a line of it for each tag; null for null.

    One fold over the lines holds what is open: nothing, a fence, a list or a table. A list goes on while items follow and a table while rows do; the rule below a
    table's head says nothing; an item inside a table leaves it open; anything else closes both. What is open at the end is closed.
    """
    some = F.array().cast("array<string>")
    kept = lambda *tags: F.filter(F.array(*tags), lambda t: t.isNotNull())

    def step(s: Column, line: Column) -> Column:
        def outside(kind: Column) -> Column:
            state = s["state"]
            now = F.when(kind == _TABLE, _TABLE).when(kind == _LIST, F.when(state == _TABLE, _TABLE).otherwise(_LIST)).when(kind == "rule", state).when(kind == _CODE, _CODE).otherwise(_NONE)
            tags = kept(F.when(state != now, _choice(state, _CLOSES)), F.when(state != now, _choice(now, _OPENS)), _told(line, kind))
            return F.struct(now.alias("state"), F.concat(s["out"], tags).alias("out"))

        inside = F.when(line.startswith("```"), F.struct(F.lit(_NONE).alias("state"), F.concat(s["out"], F.array(F.lit(_CLOSES[_CODE]))).alias("out"))).otherwise(F.struct(s["state"].alias("state"), F.concat(s["out"], F.array(escaped(line))).alias("out")))
        # The kind is told once a line.
        return F.when(s["state"] == _CODE, inside).otherwise(F.get(F.transform(F.array(_kind(line)), outside), F.lit(0)))

    end = lambda s: F.array_join(F.concat(s["out"], kept(_choice(s["state"], _CLOSES))), "\n")
    return F.aggregate(F.split(markdown, "\n", -1), F.struct(F.lit(_NONE).alias("state"), some.alias("out")), step, end)


def page(title: Column, markdown: Column) -> Column:
    """A whole page, styled for screens and for print."""
    return F.concat(F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8">\n<title>'), escaped(title), F.lit(f"</title>\n<style>{STYLE}</style></head>\n<body>"), html(markdown), F.lit("</body></html>"))
