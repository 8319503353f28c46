"""Queries over model answers written from orders and parts: nested findings cut off anywhere, and verdicts of a triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import answers
from brindle.tables import table

# Migrations as models write them, and what is left of each.
_MIGRATIONS = (
    ("CREATE INDEX i ON t (a)", True), ("omit", False), ("N/A.", False), ("add_index :t, :a", True), ("please add more memory", False), ("rename the variable", False), ("create_index(:a)", True), ("addColumn x", True), ("None needed", False),
    ("ALTER TABLE t ADD COLUMN b int", True), ("...", False), ("not applicable", False),
)
_SEVERITIES = ("critical", "low", "fatal", "info", "high")
_ITEMS = 3
_HEAD, _BETWEEN, _TAIL = 'Sure:\n{"findings": [', ", ", '], "note": "]}"}\nDone.'


def _element(k: Column, n: int) -> Column:
    """The n-th finding of order k: titles that are no texts, lines as numbers, in quotes and not at all."""
    of = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    s = k.cast("string")
    title = F.when((k + n) % 7 == 0, s).otherwise(F.concat(F.lit('"t{'), s, F.lit('\\"}"')))
    line = F.when((k + n) % 3 == 0, F.concat(F.lit(', "startLine": '), s)).when((k + n) % 3 == 1, F.concat(F.lit(', "startLine": "'), s, F.lit('"'))).otherwise("")
    return F.concat(
        F.lit('{"title": '), title, F.lit(f', "original": "o{n}]", "severity": "'), of(_SEVERITIES, k + n), F.lit('", "primaryOccurrence": {"file": "f'), s, F.lit('.py"'), line, F.lit('}, "suggestion": {"proposed": "p", "assumptions": ["a", '), F.lit(str(n)), F.lit(', {"b": [1]}], "requiredMigration": "'),
        of([m for m, _ in _MIGRATIONS], k + n), F.lit('"}, "evidence": [{"kind": "schema", "startLine": '), F.lit(str(n)), F.lit("}]}"),
    )


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): an answer an order, cut off at a place that depends on its key, whole for some."""
    k = F.col("o_orderkey")
    whole = F.concat(F.lit(_HEAD), F.concat_ws(_BETWEEN, *[_element(k, n) for n in range(1, _ITEMS + 1)]), F.lit(_TAIL))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), whole.alias("_whole"))
    return rows.select("id", F.substring("_whole", F.lit(1), (F.col("id") * 7919 % (F.length("_whole") + 20)).cast("int")).alias("raw"))


def nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.findings(answer_texts(spark, sf_dir))
    return found.select(
        "id", "at", "title", "original", "severity", "kind", F.col("occurrence.file").alias("file"), F.col("occurrence.start_line").cast("long").alias("start_line"), F.col("occurrence.end_line").cast("long").alias("end_line"), F.array_join("assumptions", "|").alias("assumptions"),
        "migration", F.get("evidence", F.lit(0))["kind"].alias("evidence_kind"), F.get("evidence", F.lit(0))["end_line"].cast("long").alias("evidence_line"), "confidence", "repaired",
    )


def answer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.errors(answer_texts(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"))


def triage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer a customer, a verdict for each of its orders, some given twice and some in words that are not known."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 4
    one = F.concat(F.lit('{"id": '), F.when(n == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"'))), F.lit(', "verdict": "'), F.when(n == 1, "problem").when(n == 2, "unsure").when(n == 3, "maybe").otherwise("clean"), F.lit('", "why": "w'), n.cast("string"), F.lit('"}'))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), one.alias("v")))).alias("vs"))
    texts = F.transform("vs", lambda v: v["v"])
    raw = F.concat(F.lit('```json\n{"verdicts": ['), F.array_join(F.concat(texts, F.transform(F.slice(texts, 1, 1), lambda v: F.replace(v, F.lit('"why": "'), F.lit('"why": "again ')))), ", "), F.lit("]}\n```"))
    return answers.verdicts(per.select(F.col("o_custkey").alias("id"), raw.alias("raw"))).select("id", "site_id", "verdict", "category", "why")


QUERIES = {f.__name__: f for f in (nested_findings, answer_errors, triage_verdicts)}

_list = lambda values: "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"
_of = lambda values, by: f"({_list(values)})[({by}) % {len(values)} + 1]"


def _element_sql(n: int) -> str:
    return f"""'{{"title": ' || CASE WHEN (k + {n}) % 7 = 0 THEN CAST(k AS VARCHAR) ELSE '"t{{' || k || '\\"}}"' END || ', "original": "o{n}]", "severity": "' || {_of(_SEVERITIES, f"k + {n}")} || '", "primaryOccurrence": {{"file": "f' || k || '.py"'
        || CASE (k + {n}) % 3 WHEN 0 THEN ', "startLine": ' || k WHEN 1 THEN ', "startLine": "' || k || '"' ELSE '' END || '}}, "suggestion": {{"proposed": "p", "assumptions": ["a", {n}, {{"b": [1]}}], "requiredMigration": "' || {_of([m for m, _ in _MIGRATIONS], f"k + {n}")} || '"}}, "evidence": [{{"kind": "schema", "startLine": {n}}}]}}'"""


_ENDS = [f"length(head) + {' + '.join(f'length(e{m})' for m in range(1, n + 1))} + {(n - 1) * len(_BETWEEN)}" for n in range(1, _ITEMS + 1)]
#: What is left of each answer: its cut, where its elements end, and where its object does.
_CUTS = f"""(SELECT *, k * 7919 % (total + {len("Done.") + 1} + 20) AS cut FROM (SELECT *, {", ".join(f"{e} AS end{n + 1}" for n, e in enumerate(_ENDS))}, {_ENDS[-1]} + {len(_TAIL) - len("Done.") - 1} AS total
    FROM (SELECT o_orderkey AS k, 'Sure:' || chr(10) || '{{"findings": [' AS head, {", ".join(f"{_element_sql(n).replace('(k +', '(o_orderkey +').replace('|| k', '|| o_orderkey').replace('(k ', '(o_orderkey ').replace('CAST(k', 'CAST(o_orderkey').replace('(k+', '(o_orderkey+').replace('[(k', '[(o_orderkey')} AS e{n}" for n in range(1, _ITEMS + 1))} FROM orders)))"""

ORACLE_SQL = {
    "nested_findings": f"""SELECT k AS id, CAST(n - 1 AS INTEGER) AS at, 't{{' || k || '"}}' AS title, 'o' || n || ']' AS original, CASE WHEN {_of(_SEVERITIES, "k + n")} = 'fatal' THEN 'medium' ELSE {_of(_SEVERITIES, "k + n")} END AS severity, 'equivalent' AS kind, 'f' || k || '.py' AS file,
        CASE WHEN (k + n) % 3 = 2 THEN 0 ELSE k END AS start_line, CASE WHEN (k + n) % 3 = 2 THEN 0 ELSE k END AS end_line, 'a|' || n || '|{{"b":[1]}}' AS assumptions, {_of([m if kept else None for m, kept in _MIGRATIONS], "k + n")} AS migration, 'schema' AS evidence_kind, CAST(n AS BIGINT) AS evidence_line, 0.5e0 AS confidence, cut < total AS repaired
        FROM {_CUTS} c, (VALUES (1), (2), (3)) v(n) WHERE (k + n) % 7 <> 0 AND cut >= CASE n WHEN 1 THEN end1 WHEN 2 THEN end2 ELSE end3 END""",
    "answer_errors": f"SELECT CASE WHEN cut = 0 THEN 'empty' WHEN cut < 7 THEN 'no-object' ELSE 'not-json' END AS error, count(*) AS n FROM {_CUTS} c WHERE cut < end1 GROUP BY 1",
    "triage_verdicts": """SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS site_id, CASE o_orderkey % 4 WHEN 1 THEN 'problem' WHEN 2 THEN 'unsure' ELSE 'clean' END AS verdict, 'other' AS category, 'w' || (o_orderkey % 4) AS why FROM orders""",
}
