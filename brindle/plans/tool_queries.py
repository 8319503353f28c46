"""Queries through the entries that need no model, functions registered by name, fingerprints, and counters observed while a scan writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import detect, fingerprint, progress, registered, tools
from brindle.plans import code_queries
from brindle.plans.capture_queries import odd_plan_captures
from brindle.plans.capture_queries import ORACLE_SQL as _CAPTURES
from brindle.plans.code_queries import code_files
from brindle.tables import table

# Pairs of snippets: original, proposed, and what is told: reader, status, hard, soft, undecided.
_PAIRS = (
    ("SELECT a FROM t WHERE x = 1", "select a from t where x = 1", "sql", "machine-verified", "", "", ""),
    ("SELECT a FROM t", "SELECT a, b FROM t LIMIT 5", "sql", "contradicted", "projection", "row-limit", ""),
    ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x = 2 ORDER BY a", "sql", "partially-verified", "", "order-by", "where"),
    ("DELETE FROM t WHERE a = 1", "DELETE FROM t WHERE a = 1", "sql", "partially-verified", "", "", "values"),
    ("Order.objects.filter(a=1).count()", "Order.objects.filter(a=1).count()", "orm", "machine-verified", "", "", ""),
    ("Order.objects.filter(a=1).count()", "Order.objects.filter(a=1).exists()", "orm", "contradicted", "terminal", "", ""),
    ("Order.objects.filter(a=1)", "Order.objects.filter(b=2)", "orm", "partially-verified", "", "", "predicates"),
    ("prisma.user.findMany({ where: { a: 1 } })", "prisma.user.findMany({ where: { a: 1 }, take: 5 })", "orm", "partially-verified", "", "row-limit", ""),
    ("x = 1", "y = 2", "sql", "unverifiable", "", "", ""),
    ("", "SELECT 1", "sql", "unverifiable", "", "", ""),
)


def check_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of snippets for each supplier."""
    k = (F.col("s_suppkey") % len(_PAIRS)).cast("int")
    of = lambda c: F.get(F.array(*[F.lit(p[c]) for p in _PAIRS]), k)
    told = tools.check_equivalence(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), of(0).alias("original"), of(1).alias("proposed")))
    return told.select("id", "reader", "status", *[F.array_join(c, ",").alias(c) for c in ("hard", "soft", "undecided")])


def rule_hits_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_hits in SQL, through a table function."""
    registered.register(spark)
    code_files(spark, sf_dir).createOrReplaceTempView("brindle_files")
    return spark.sql("SELECT h.rule, count(*) AS hits, count(DISTINCT f.path) AS files FROM brindle_files f, LATERAL regex_hits(f.path, f.content) h GROUP BY h.rule")


def spans_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each file, folded by a table function over the hits of each path; and how many there are by hits."""
    registered.register(spark)
    detect.hits(code_files(spark, sf_dir)).createOrReplaceTempView("brindle_hits")
    return spark.sql("SELECT path, start, end, hits FROM hit_spans(TABLE(SELECT path, rule, start, end FROM brindle_hits))")


def plan_nodes_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON plans among odd captures, in SQL."""
    registered.register(spark)
    odd_plan_captures(spark, sf_dir).createOrReplaceTempView("brindle_captures")
    return spark.sql("SELECT c.capture_id, n.node, n.node_type, n.relation, n.estimated_rows, n.actual_rows, n.loops FROM brindle_captures c, LATERAL plan_nodes(c.raw) n")


def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a scan, observed while its sites are written."""
    scanned, observed = progress.observed_scan(code_files(spark, sf_dir))
    scanned.write.format("noop").mode("overwrite").save()
    seen = observed.get
    return spark.range(1).select(*[F.lit(seen[c]).cast("long").alias(c) for c in (*progress.COUNTERS, "truncated")])


def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.col("text").alias("content"))
    return fingerprint.fingerprint(files)


QUERIES = {f.__name__: f for f in (check_equivalence, rule_hits_by_name, spans_by_name, plan_nodes_by_name, scan_progress, source_fingerprint)}


def _level(k: int) -> str:
    """One level of ranges; a single row stays as it is but for the first level."""
    return f"""n{k} AS (SELECT *, sum(CASE WHEN sha256('{k}:' || path)[1:{fingerprint.ZEROS}] = '{"0" * fingerprint.ZEROS}' THEN 1 ELSE 0 END) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS r, count(*) OVER () AS total FROM r{k}),
        r{k + 1} AS (SELECT min(path) AS path, CASE WHEN {k} > 0 AND max(total) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY path)) END AS digest, sum(files) AS files FROM n{k} GROUP BY r)"""


_LEVELS = 8
ORACLE_SQL = {
    "check_equivalence": "SELECT s_suppkey AS id, reader, status, hard, soft, undecided FROM supplier JOIN (VALUES " + ", ".join("(" + str(i) + ", " + ", ".join(f"'{c}'" for c in p[2:]) + ")" for i, p in enumerate(_PAIRS)) + f") v(k, reader, status, hard, soft, undecided) ON s_suppkey % {len(_PAIRS)} = k",
    "rule_hits_by_name": code_queries.ORACLE_SQL["rule_hits"],
    "plan_nodes_by_name": f"SELECT * FROM ({_CAPTURES['odd_plan_nodes']}) x WHERE capture_id % 7 IN (0, 3)",
    "scan_progress": code_queries.ORACLE_SQL["detect_totals"],
    "source_fingerprint": f"""WITH r0 AS (SELECT 'src/' || source || '/d' || doc_id || '.ts' AS path, sha256('src/' || source || '/d' || doc_id || '.ts' || coalesce(text, '')) AS digest, 1 AS files FROM documents WHERE source IS NOT NULL),
        {", ".join(_level(k) for k in range(_LEVELS))} SELECT left(max(digest), {fingerprint.DIGITS}) AS fingerprint, CAST(sum(files) AS BIGINT) AS files FROM r{_LEVELS}""",
}
