"""Queries over what leaves the library: differences, fixtures, summaries, estimates and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import markdown, text
from brindle.functions.paths import is_schema_file
from brindle.operators import matching, metrics, profile, ranking, recipes, report
from brindle.plans.code_queries import code_files
from brindle.sources import sinks
from brindle.tables import table

NOW = "2024-01-20 00:00:00"
_KEPT = 5


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order, and one in which a line went and two came."""
    k = F.col("o_orderkey").cast("string")
    lines = lambda *parts: F.array_join(F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts]), "\n")
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", lines("a", k, "b", "c").alias("before"), lines("a", "b", "x", "c", F.concat(F.lit("y"), k)).alias("after"))
    return report.diff_rows(pairs, "o_orderkey", "before", "after")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("regression", "confirmed", "no-difference", "insufficient-evidence")]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit("src/a b.py").alias("path"), F.lit(3).alias("line"), F.lit("full-scan").alias("category"), F.lit("high").alias("severity"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.lit("q").alias("original"), F.lit("r").alias("proposed"),
        F.when(k % 3 == 0, F.array(F.lit("1 fewer column(s)"))).otherwise(F.array().cast("array<string>")).alias("counted"), F.lit("verified").alias("grounding"), verdict.alias("verdict"), F.array(F.lit("blocks 1 -> 2"), F.lit("time 3 -> 4")).alias("because"),
    )


def fixture_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = report.fixtures(_judged(spark, sf_dir), F.lit("Own/Repo"), F.lit("abcdef0123"), F.lit(NOW))
    return f.select("id", "file", F.get_json_object("content", "$.verdict").alias("verdict"), F.get_json_object("content", "$.finding.title").alias("title"), F.get_json_object("content", "$.evidence[1]").alias("second"))


def issue_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issues(_judged(spark, sf_dir), F.lit("Own/Repo"), F.lit("abcdef0123"))


def profile_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engines that parts declare, in a line."""
    p = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("engine"), (F.lit(100) - F.col("p_size") % 4 * 10).cast("int").alias("authority"), F.col("p_partkey").alias("ord"))
    found = profile.engine_profile(p, "engine", "authority", "ord")
    return report.described_profile(found.withColumn("quote", F.concat(F.lit("part "), F.col("first_seen").cast("string"))))


def metric_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    r = lambda test: metrics.ratio(F.sum(test.cast("long")), F.count("*"))
    runs = li.groupBy("l_returnflag", "l_linenumber").agg(r(F.col("l_discount") > 0.05).alias("precision"), r(F.col("l_quantity") > 0).alias("recall"))
    return report.scorecard(metrics.summary(runs, ["l_returnflag"], ["precision", "recall"]), ["l_returnflag"])


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of markdown for each part: headings, a table, a list, a fence, a quote and inline marks."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    md = F.concat(
        F.lit("# "), name, F.lit(" & co\n\n| Type | Size |\n|---|---:|\n| "), F.col("p_type"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n- `x<"), k, F.lit("`\n\n- **bold** _"), k, F.lit("_\n- two\n## Code\n```sql\nSELECT a FROM t WHERE b < "), k,
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise("\n- no item\n```\n> said \"so\"\n---\nlast"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", markdown.html(md).alias("html"))


def adjudicated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs in a folder of their customer; adjudications are by customer, some twice, and name the folder with what ends it."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("runs/c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    key = F.concat(F.lit("/c"), F.col("c_custkey").cast("string"), F.lit("/")).alias("key")
    verdicts = c.select(key, F.col("c_mktsegment").alias("adjudicated"), F.lit(2).alias("ord")).unionByName(c.filter("c_custkey % 4 = 0").select(key, F.lit("first").alias("adjudicated"), F.lit(1).alias("ord")))
    return matching.adjudicated(runs, verdicts).select("run", "adjudicated")


def adjudicated_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs named by clerk, priority and order; adjudications name the clerk's number, parts of a name, or parts of two folders."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run"), F.concat_ws("/", F.lit("runs"), F.concat(F.lit("clerk#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), F.regexp_replace(F.lower("o_orderpriority"), " ", ""), F.col("o_orderkey").cast("string")).alias("path"))
    s, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    key = F.when(s % 5 == 0, F.concat(F.lit("clerk#"), F.lpad(n, 9, "0"), F.lit("/"))).when(s % 5 == 1, F.concat(F.lit("high/"), n)).when(s % 5 == 2, F.concat(F.lit("-"), n)).when(s % 5 == 3, "").otherwise(F.concat(F.lit("0"), n, F.lit("/1-urgent")))
    verdicts = table(spark, sf_dir, "supplier").select(key.alias("key"), F.col("s_name").alias("adjudicated"), s.alias("ord"))
    return matching.adjudicated(runs, verdicts).select("run", "adjudicated")


def schema_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve files that are read first."""
    return report.schema_first(code_files(spark, sf_dir), is_schema_file(F.col("path")), 12).select("path", "is_schema")


def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ten days as entries of a store."""
    s = ranking.store_summary(table(spark, sf_dir, "events"), "ts", F.lit(NOW).cast("timestamp"), 10 * 86400, "event_type")
    return s.withColumn("kinds", F.array_join("kinds", ","))


def budget_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passes over a customer's file: those in progress are left."""
    return ranking.budget_left(table(spark, sf_dir, "orders"), F.col("o_orderstatus") != "P", "o_orderkey", "o_custkey")


def estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.ceil(F.col("n_chars") / 3.6).cast("long").alias("tokens"))
    return ranking.estimate(d, "tokens", 3, 4000, 0.5, 2.0)


def chunk_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", ranking.chunk_capacity(F.round("o_totalprice").cast("long"), F.lit(2000), (F.col("o_custkey") * 10).cast("long")).alias("capacity"))


def shown_with_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest orders, and how many are left out."""
    return ranking.shown_with_rest(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], _KEPT).select("o_orderkey", "left_out")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys of a cache: parts that differ only in where they end give different keys."""
    c = table(spark, sf_dir, "customer")
    key = ranking.cache_key(F.lit(3), F.col("c_custkey"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise("x"))
    return c.select("c_custkey", key.alias("key"))


def observed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that suppliers, customers and parts know, once."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("tab"))
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 == 0, "<unknown>").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tab"))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tab"))
    return report.observed_names(s, c, p)


def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on orders as findings of their customer's file, without the files' sections; those of a priority are held back."""
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_custkey") % 3 == 0, "high").otherwise("low")
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("start_line"), level.alias("severity"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("title"), F.lit("a").alias("original"), F.lit("b").alias("proposed"),
                    F.when(F.col("o_orderkey") % 4 == 0, "behavioural").otherwise("equivalent").alias("kind"), F.when(F.col("o_orderkey") % 5 == 0, "no-op").when(F.col("o_orderkey") % 5 == 1, "cold-path").alias("reason"))
    coverage = o.agg(F.count_distinct("o_custkey").alias("files"), F.count_distinct("o_custkey").alias("read"), F.count("*").alias("matched"))
    return sinks.document(rows.filter("reason IS NULL"), rows.filter("reason IS NOT NULL"), coverage).filter("part <> 2")


def patch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of orders as findings, a line of three changed."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.lit("a.py").alias("path"), k.alias("start_line"), F.concat(F.lit("x\n"), k.cast("string"), F.lit("\ny")).alias("original"), F.lit("x\nz\ny").alias("proposed"), F.when(k % 4 == 0, "behavioural").otherwise("equivalent").alias("kind"))
    return sinks.patches(rows)


def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.left_out(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "behavioural").otherwise("equivalent").alias("kind")))


def evidence_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: of those of one user and kind the latest stays, and of all that stay, each user's three newest."""
    latest = ranking.latest_by_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return ranking.top_k(latest, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_type", "event_id")


def masked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask_key(F.concat(F.lit("key-"), F.repeat(F.lit("x"), (F.col("c_custkey") % 9).cast("int")), F.col("c_custkey").cast("string"))).alias("shown"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that says something, of texts with line numbers in front."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.first_significant_line(F.concat(F.lit("1 | x\n 2| "), F.when(k % 2 == 0, "short").otherwise("select everything"), F.lit("\n3| the third line "), k.cast("string"))).alias("line"))


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "orders")
    return li.select("o_orderkey", text.percent(F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 200) / 100)).alias("share"), text.dollars(F.round("o_totalprice", 2)).alias("cost"), text.milliseconds(F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 1000) / 10)).alias("time"))


def statement_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts the statements of each part's snippet."""
    names = F.array(*[F.lit(d) for d in (*recipes.COUNTERS, "other")])
    return table(spark, sf_dir, "part").select("p_partkey", recipes.counter_of(F.get(names, (F.col("p_partkey") % (len(recipes.COUNTERS) + 1)).cast("int"))).alias("counter"))


QUERIES = {
    f.__name__: f
    for f in (report_parts, patch_export, patch_counts, evidence_store, masked_keys, first_lines, formatted, statement_counters, diff_lines, fixture_export, issue_export, profile_line, metric_scorecard, report_html, adjudicated_runs, adjudicated_within, schema_first, store_summary, budget_left, estimate, chunk_capacity, shown_with_rest, cache_keys, observed_names)
}
_VERDICT = "(SELECT o_orderkey AS id, list_extract(['regression', 'confirmed', 'no-difference', 'insufficient-evidence'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS verdict FROM orders WHERE o_orderkey % 4 IN (0, 2))"
_ORDERS = "(SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 5 WHEN 0 THEN 'no-op' WHEN 1 THEN 'cold-path' END AS reason, CASE WHEN o_custkey % 3 = 0 THEN 'high' ELSE 'low' END AS severity, o_orderkey % 4 = 0 AS b FROM orders)"
ORACLE_SQL = {
    "report_parts": f"""SELECT 0 AS part, '' AS key, count(DISTINCT o_custkey) || ' of ' || count(DISTINCT o_custkey) || ' files read, ' || count(*) || ' sites matched' AS text FROM orders
        UNION ALL SELECT 1, severity, '| ' || severity || ' | ' || count(*) FILTER (WHERE NOT b) || ' | ' || count(*) FILTER (WHERE b) || ' |' FROM {_ORDERS} o WHERE reason IS NULL GROUP BY severity
        UNION ALL SELECT 3, reason, reason || ': ' || count(*) || ', the first t' || arg_min(k, ('c' || c, k)) || ' (' || min('c' || c) || ':' || arg_min(k, ('c' || c, k)) || ')' FROM {_ORDERS} o WHERE reason IS NOT NULL GROUP BY reason""",
    "patch_export": """SELECT 'a.py' AS path, o_orderkey AS start_line, E'--- a/a.py\\n+++ b/a.py\\n@@ -' || o_orderkey || ',3 +' || o_orderkey || E',3 @@\\n x\\n-' || o_orderkey || E'\\n+z\\n y\\n' AS patch FROM orders WHERE o_orderkey % 4 <> 0""",
    "patch_counts": "SELECT count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS patches, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS left_out FROM orders",
    "evidence_store": """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_type, event_id FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
    "masked_keys": "SELECT c_custkey, CASE WHEN length(k) <= 8 THEN repeat('*', length(k)) ELSE left(k, 4) || repeat('*', length(k) - 8) || right(k, 4) END AS shown FROM (SELECT c_custkey, 'key-' || repeat('x', c_custkey % 9) || c_custkey AS k FROM customer)",
    "first_lines": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'the third line ' || p_partkey ELSE 'select everything' END AS line FROM part",
    "formatted": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 200 AS VARCHAR) || '%' ELSE '–' END AS share, '$' || format('{:,.2f}', round(o_totalprice, 2)) AS cost, CASE WHEN o_orderkey % 3 > 0 THEN format('{:.1f}', (o_orderkey % 1000) / 10.0e0) || 'ms' ELSE 'unknown' END AS time FROM orders",
    "statement_counters": "SELECT p_partkey, list_extract([" + ", ".join("'" + c.replace("'", "''") + "'" for c in (*recipes.COUNTERS.values(), "the database's statement log")) + f"], CAST(p_partkey % {len(recipes.COUNTERS) + 1} + 1 AS INTEGER)) AS counter FROM part",
    "diff_lines": """SELECT o_orderkey, v.place AS "at", kind, left_no, right_no, replace(text, '#', CAST(o_orderkey AS VARCHAR)) AS text FROM orders, (VALUES (0, 'ctx', 1, 1, 'a'), (1, 'del', 2, NULL, '#'), (2, 'ctx', 3, 2, 'b'), (3, 'add', NULL, 3, 'x'), (4, 'ctx', 4, 4, 'c'), (5, 'add', NULL, 5, 'y#')) v(place, kind, left_no, right_no, text)""",
    "fixture_export": f"SELECT id, 'own-repo-src-a-b.py-' || id || '.json' AS file, verdict, 't' || id AS title, 'time 3 -> 4' AS second FROM {_VERDICT} v",
    "issue_export": f"""SELECT id, '### A finding that measurement ' || CASE verdict WHEN 'regression' THEN 'contradicted' ELSE 'did not support' END || E'\\n\\n**Repository:** Own/Repo @ abcdef01\\n**Finding:** t' || id || E'\\n**Place:** src/a b.py:3\\n\\n**Measured**\\n- blocks 1 -> 2\\n- time 3 -> 4\\n\\n'
        || CASE WHEN id % 3 = 0 THEN E'**Counted before**\\n- 1 fewer column(s)' ELSE '_Nothing was counted from the two versions._' END || E'\\n\\n**Proposal**\\n```\\nr\\n```' AS body FROM {_VERDICT} v""",
    "profile_line": """WITH b AS (SELECT lower(p_brand) AS engine, max(100 - p_size % 4 * 10) AS authority, min(p_partkey) AS first_seen FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY authority DESC, first_seen, engine) AS n FROM b)
        SELECT string_agg(engine || ' (part ' || first_seen || ')', ', ' ORDER BY n) FILTER (WHERE n <= 6) AS described, greatest(count(*) - 6, 0) AS more FROM r""",
    "metric_scorecard": """WITH r AS (SELECT l_returnflag, l_linenumber, round(sum(CASE WHEN l_discount > 0.05e0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, round(avg(v), 4) AS m, min(v) AS a, max(v) AS b FROM r GROUP BY 1)
        SELECT l_returnflag, 'precision ' || CAST(round(m * 100) AS INTEGER) || '%' || CASE WHEN a = b THEN '' ELSE ' (' || CAST(round(a * 100) AS INTEGER) || '%–' || CAST(round(b * 100) AS INTEGER) || '%)' END || ' | recall 100%' AS line FROM s""",
    "report_html": """SELECT p_partkey, '<h1>' || p_name || ' &amp; co</h1>' || chr(10) || '<table>' || chr(10) || '<tr><td>Type</td><td>Size</td></tr>' || chr(10) || '<tr><td>' || p_type || '</td><td>' || p_size || '</td></tr>' || chr(10) || '<li><code>x&lt;' || p_partkey || '</code></li>' || chr(10) || '</table>' || chr(10)
        || '<ul>' || chr(10) || '<li><strong>bold</strong> <em>' || p_partkey || '</em></li>' || chr(10) || '<li>two</li>' || chr(10) || '</ul>' || chr(10) || '<h2>Code</h2>' || chr(10) || '<pre><code>' || chr(10) || 'SELECT a FROM t WHERE b &lt; ' || p_partkey || chr(10)
        || CASE WHEN p_partkey % 3 = 0 THEN '</code></pre>' ELSE '- no item' || chr(10) || '</code></pre>' || chr(10) || '<blockquote>said &quot;so&quot;</blockquote>' || chr(10) || '<hr>' || chr(10) || '<p>last</p>' END AS html FROM part""",
    "adjudicated_within": """WITH r AS (SELECT o_orderkey AS run, concat_ws('/', 'runs', 'clerk#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), replace(lower(o_orderpriority), ' ', ''), CAST(o_orderkey AS VARCHAR)) AS path FROM orders),
        v AS (SELECT s_suppkey AS ord, s_name, CASE s_suppkey % 5 WHEN 0 THEN 'clerk#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '/' WHEN 1 THEN 'high/' || s_suppkey WHEN 2 THEN '-' || s_suppkey WHEN 3 THEN '' ELSE '0' || s_suppkey || '/1-urgent' END AS key FROM supplier)
        SELECT run, (SELECT arg_min(s_name, ord) FROM v WHERE key <> '' AND contains(path, key)) AS adjudicated FROM r""",
    "adjudicated_runs": "SELECT o_orderkey AS run, CASE WHEN c_custkey IS NULL OR o_custkey % 2 <> 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 'first' ELSE c_mktsegment END AS adjudicated FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "schema_first": """SELECT path, k = 3 AS is_schema FROM (SELECT DISTINCT o_custkey % 4 AS k, CASE o_custkey % 4 WHEN 0 THEN 'app/views/v' || o_custkey || '.py' WHEN 1 THEN 'src/s' || o_custkey || '.ts' WHEN 2 THEN 'jobs/j' || o_custkey || '.rb' ELSE 'db/migrate/m' || o_custkey || '.sql' END AS path
        FROM orders JOIN customer ON c_custkey = o_custkey) ORDER BY k = 3 DESC, path LIMIT 12""",
    "store_summary": f"SELECT count(*) AS live, max(a) AS oldest_seconds, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts)) AS BIGINT) AS a FROM events) WHERE a BETWEEN 0 AND 863999",
    "budget_left": "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS passes_left, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS sites_left, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'P') AS files_left FROM orders",
    "estimate": """WITH t AS (SELECT CAST(sum(CAST(ceil(n_chars / 3.6e0) AS BIGINT)) AS BIGINT) AS n, count(*) AS c FROM documents), e AS (SELECT n * 3 AS triage_tokens, CAST(ceil(n * 0.1e0) AS BIGINT) AS author_tokens, CAST(ceil(c * 0.1e0 * 4000 * 0.35e0) AS BIGINT) AS output_tokens FROM t)
        SELECT triage_tokens, author_tokens, output_tokens, round(((triage_tokens + author_tokens) * 0.5e0 + output_tokens * 2.0e0) / 1e6, 4) AS cost FROM e""",
    "chunk_capacity": "SELECT o_orderkey, CAST(greatest(1500, floor((CAST(round(o_totalprice) AS BIGINT) - 2000 - o_custkey * 10) * 0.8e0)) AS BIGINT) AS capacity FROM orders",
    "shown_with_rest": f"SELECT o_orderkey, (SELECT greatest(count(*) - {_KEPT}, 0) FROM orders) AS left_out FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {_KEPT}",
    "cache_keys": "SELECT c_custkey, sha256('3' || chr(0) || c_custkey || chr(0) || c_mktsegment || chr(0) || CASE WHEN c_custkey % 2 = 0 THEN chr(1) ELSE 'x' END) AS key FROM customer",
    "observed_names": "SELECT lower(tab) AS tab FROM (SELECT 'n' || s_nationkey AS tab FROM supplier UNION SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 10 <> 0 UNION SELECT lower(p_brand) FROM part)",
}
