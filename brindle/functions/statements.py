"""The shape of SQL statements, read with column expressions, and what two shapes say about two statements.

Text in brackets is written in other characters while clauses are looked for, so that no comma or keyword in it counts, and
back afterwards: brackets may nest to any depth.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The clauses of a statement, and the operations between two.
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "WINDOW", "QUALIFY", "ORDER BY", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT")
SET_OPS = ("UNION", "INTERSECT", "EXCEPT")

#: Comments, strings, quoted names, and what stands between them; a quote that never closes takes the rest.
_TOKENS = r"""--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|'[^'\\]*+(?:(?:\\(?s:.)|'')[^'\\]*+)*+(?:'|\z)|"[^"\\]*+(?:(?:\\(?s:.)|"")[^"\\]*+)*+(?:"|\z)|`[^`\\]*+(?:(?:\\(?s:.)|``)[^`\\]*+)*+(?:`|\z)|[^-/'"`]+|(?s:.)"""
_PLAIN = string.ascii_letters + " ,$_()"
#: Private characters that stand for _PLAIN within brackets.
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_PLAIN)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_literals(sql: Column) -> Column:
    """The statement without comments; every string is '§', and quoted names stand in double quotes."""
    tokens = F.regexp_extract_all(sql, F.lit(_TOKENS), F.lit(0))
    name = lambda t: F.concat(F.lit('"'), F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))), F.lit('"'))
    told = lambda t: F.when(t.startswith("--"), "").when(t.startswith("/*"), " ").when(t.startswith("'"), "'§'").when(t.startswith('"') | t.startswith("`"), name(t)).otherwise(t)
    return F.array_join(F.transform(tokens, told), "")


def top_level(sql: Column) -> Column:
    """strip_literals with white space as one space, and everything in brackets hidden."""
    pieces = F.regexp_extract_all(collapsed(strip_literals(sql)), F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(acc["text"], F.when((acc["depth"] > 0) & (depth > 0), F.translate(p, _PLAIN, _HIDDEN)).otherwise(p)).alias("text"))

    return F.aggregate(pieces, start, step, lambda acc: acc["text"])


def shown(text: Column) -> Column:
    """What top_level has hidden, as it was."""
    return F.translate(text, _HIDDEN, _PLAIN)


def split_top_level(text: Column, separator: str = ",") -> Column:
    """Parts between the separators that stand in no bracket, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(shown(p))), lambda p: p != "")


_WORD = r"(?<![\w$]){}(?![\w$])"
_NEXT = r"(?=" + _WORD.format("(?:" + "|".join(CLAUSES) + ")") + r"|$)"


def section(top: Column, name: str) -> Column:
    """The text from a clause of top_level up to the next one, hidden text still hidden; empty if it has none."""
    return F.trim(F.regexp_extract(top, "(?i)" + _WORD.format(name) + "(.*?)" + _NEXT, 1))


def _shape(t: Column) -> Column:
    kind = (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.rlike(r"(?i)^(?:create|drop)\s+(?:unique\s+)?index\b|^alter\s+table\s+\S+\s+(?:add|drop)\s+(?:constraint|index|key)\b"), "ddl-index")
        .when(t.rlike(r"(?i)^(?:with\b.*?\)\s*)?select\b"), "select")
        .when(t.rlike(r"(?i)^insert"), "insert")
        .when(t.rlike(r"(?i)^update"), "update")
        .when(t.rlike(r"(?i)^delete"), "delete")
        .otherwise("other")
    )
    is_select = kind == "select"
    picked = section(t, "SELECT")
    projection = F.regexp_replace(picked, r"(?i)^(?:all|distinct)\b\s*", "")
    top = F.regexp_extract(projection, r"(?i)^TOP\s*\(?\s*(\d+)\s*\)?", 1)
    items = F.transform(split_top_level(F.regexp_replace(projection, r"(?i)^TOP\s*\(?\s*(\d+)\s*\)?", "")), lambda x: F.lower(F.regexp_replace(x, r"(?i)\s+as\s+", " as ")))
    order = F.transform(split_top_level(section(t, "ORDER BY")), lambda x: F.when(F.lower(x).rlike(r"\b(?:asc|desc)$"), F.lower(x)).otherwise(F.concat(F.lower(x), F.lit(" asc"))))
    of = lambda name: F.when(is_select, shown(section(t, name))).otherwise("")
    none = F.array().cast("array<string>")
    limit = F.coalesce(F.nullif(top, F.lit("")), F.nullif(shown(section(t, "LIMIT")), F.lit("")), shown(section(t, "FETCH")))
    return F.struct(
        kind.alias("kind"),
        (is_select & picked.rlike(r"(?i)^distinct\b")).alias("distinct"),
        F.when(is_select, items).otherwise(none).alias("projection"),
        of("FROM").alias("source"),
        # Of other statements the condition reaches to their end.
        F.when(is_select, shown(section(t, "WHERE"))).when(kind.isin("insert", "update", "delete"), F.trim(shown(F.regexp_extract(t, "(?i)" + _WORD.format("WHERE") + "(.*)$", 1)))).otherwise("").alias("where"),
        F.when(is_select, F.transform(split_top_level(section(t, "GROUP BY")), lambda x: F.lower(x))).otherwise(none).alias("group_by"),
        of("HAVING").alias("having"),
        F.when(is_select, order).otherwise(none).alias("order_by"),
        F.when(is_select, limit).otherwise("").alias("limit"),
        of("OFFSET").alias("offset"),
        F.when(is_select, F.transform(F.regexp_extract_all(t, F.lit("(?i)" + _WORD.format("(" + "|".join(SET_OPS) + ")")), F.lit(1)), lambda x: F.upper(x))).otherwise(none).alias("set_ops"),
        F.when(is_select, F.regexp_count(shown(section(t, "FROM")), F.lit(r"(?i)\bjoin\b"))).otherwise(0).alias("joins"),
    )


def with_sql_shapes(df: DataFrame, **statements: Column) -> DataFrame:
    """df with a column for each of the named statements: a struct of what can be compared without understanding it; kind null for an empty one, 'other' for what is no SQL."""
    tops = df.select("*", *[top_level(F.coalesce(c, F.lit(""))).alias(f"_top_{n}") for n, c in statements.items()])
    return tops.select(*df.columns, *[_shape(F.col(f"_top_{n}")).alias(n) for n in statements])


def _names(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in pairs]), lambda x: x.isNotNull())


def sql_deltas(a: Column, b: Column) -> Column:
    """struct(hard, soft, undecided): the properties in which two selections differ; hard ones change the output, undecided ones are never proved."""
    return F.struct(
        _names([(a["projection"] != b["projection"], "projection"), (a["distinct"] != b["distinct"], "distinct"), (a["group_by"] != b["group_by"], "group-by"), (a["set_ops"] != b["set_ops"], "set-ops")]).alias("hard"),
        _names([(a["order_by"] != b["order_by"], "order-by"), ((a["limit"] != b["limit"]) | (a["offset"] != b["offset"]), "row-limit")]).alias("soft"),
        _names([(a["where"] != b["where"], "where"), (a["source"] != b["source"], "from"), (a["having"] != b["having"], "having")]).alias("undecided"),
    )


def status_of(deltas: Column) -> Column:
    return F.when(F.size(deltas["hard"]) > 0, "contradicted").when((F.size(deltas["soft"]) > 0) | (F.size(deltas["undecided"]) > 0), "partially-verified").otherwise("machine-verified")


def equivalence(a: Column, b: Column, calls: Column | None = None) -> Column:
    """struct(status, hard, soft, undecided) of two SQL shapes. calls: the same of the two as code (calls.call_deltas), for what is no SQL.

    In order: an empty side, two index definitions, no SQL on a side, another kind of statement, statements that write, selections.
    """
    none = F.array().cast("array<string>")
    told = lambda status, hard=none, soft=none, undecided=none: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), hard.alias("hard"), soft.alias("soft"), undecided.alias("undecided"))
    one = lambda name: F.array(F.lit(name))
    deltas = sql_deltas(a, b)
    no_sql = told("unverifiable") if calls is None else F.coalesce(calls, told("unverifiable"))
    return (
        F.when(a["kind"].isNull() | b["kind"].isNull(), told("unverifiable"))
        .when((a["kind"] == "ddl-index") & (b["kind"] == "ddl-index"), told("machine-verified"))
        .when((a["kind"] == "other") | (b["kind"] == "other"), no_sql)
        .when(a["kind"] != b["kind"], told("contradicted", hard=one("statement")))
        .when((a["kind"] != "select") & (a["where"] == b["where"]), told("partially-verified", undecided=one("values")))
        .when(a["kind"] != "select", told("unverifiable", undecided=one("where")))
        .otherwise(told(status_of(deltas), deltas["hard"], deltas["soft"], deltas["undecided"]))
    )
