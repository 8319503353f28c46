"""Queries over pasted texts: plans, catalogs and logs written from orders, parts and customers, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import captures
from brindle.tables import table


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def plan_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, raw): a plan for each order, a scan a line: in text form, or as JSON for even keys."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_suppkey", (F.col("l_partkey") % 5).alias("rel"))
    q, n, s, loops = F.col("q"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_suppkey") % 3 + 1
    node = _text("  ->  Seq Scan on t", F.col("rel"), "  (cost=0.00..1.00 rows=", q, " width=8) (actual time=0.01..", n, ".5 rows=", q, " loops=", loops, ")\n        Filter: (a = ANY ('{1}'::int[]))\n        Rows Removed by Filter: ", s, "\n        Buffers: shared hit=", q, " read=", n)
    child = F.struct(F.lit("Seq Scan").alias("Node Type"), F.concat(F.lit("t"), F.col("rel").cast("string")).alias("Relation Name"), q.alias("Plan Rows"), q.alias("Actual Rows"), (n + 0.5).alias("Actual Total Time"), loops.alias("Actual Loops"), s.alias("Rows Removed by Filter"), q.alias("Shared Hit Blocks"), n.alias("Shared Read Blocks"))
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", node.alias("node"), child.alias("child")))).alias("c"))
    count = F.col("n")
    text = _text("QUERY PLAN\n-----\nSort  (cost=0.00..9.00 rows=", count, " width=8) (actual time=0.10..", count, ".75 rows=", count, " loops=1)\n  Sort Method: external merge  Disk: 10kB\n", F.array_join(F.transform("c", lambda x: x["node"]), "\n"), "\nPlanning Time: 0.5 ms\nExecution Time: ", count, ".25 ms")
    root = F.struct(F.lit("Sort").alias("Node Type"), count.alias("Plan Rows"), count.alias("Actual Rows"), (count + 0.75).alias("Actual Total Time"), F.lit(1).alias("Actual Loops"), F.lit("external merge").alias("Sort Method"), F.lit("Disk").alias("Sort Space Type"), F.lit(10).alias("Sort Space Used"), F.transform("c", lambda x: x["child"]).alias("Plans"))
    document = F.to_json(F.array(F.struct(root.alias("Plan"), F.lit(0.5).alias("Planning Time"), (count + 0.25).alias("Execution Time"))))
    return per.select(F.col("l_orderkey").alias("capture_id"), F.when(F.col("l_orderkey") % 2 == 0, document).otherwise(text).alias("raw"))


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = plan_captures(spark, sf_dir)
    nodes = captures.plan_documents(raw).drop("depth").unionByName(captures.plan_texts(raw.filter("capture_id % 2 = 1")).drop("indent"))
    return nodes.withColumn("node", F.col("node") == 0).withColumnRenamed("node", "root")


def odd_plan_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, raw): a capture for each order, as people paste them: with a row count after it, a plan that is none, fields of other types, nodes in nodes, JSON that breaks off, and text with a bracket before the plan."""
    k = F.col("o_orderkey")
    forms = [
        _text('QUERY PLAN\n-----\n [\n  {"Plan": {"Node Type": "Seq Scan", "Relation Name": "a', k, '", "Plan Rows": ', k, '}}\n]\n(1 row)\n'),
        F.lit('[{"Plan": null}]'),
        F.lit('{"Plan": "Seq Scan"}'),
        _text('{"Plan": {"Node Type": 5, "Plan Rows": "many", "Actual Loops": true, "Relation Name": ["x"], "Plans": [{"Node Type": "Hash", "Actual Rows": 2, "Actual Loops": 3, "Plans": [{"Index Name": "i', k, '"}, 7, null]}, "none"]}} and more'),
        _text('[{"Plan": {"Node Type": "Seq\nSeq Scan on t', k, "  (cost=0.00..1.00 rows=", k, " width=8)"),
        _text("Seq Scan on u  (cost=0.00..1.00 rows=", k, " width=8)\n  Filter: (a = ANY ('{1}'::int[]))\n"),
        F.lit('[] "Plan"'),
    ]
    return table(spark, sf_dir, "orders").select(k.alias("capture_id"), F.get(F.array(*forms), (k % len(forms)).cast("int")).alias("raw"))


def odd_plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.plan_nodes(odd_plan_captures(spark, sf_dir)).select("capture_id", "node", "node_type", "relation", "estimated_rows", "actual_rows", "loops")


def plan_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.plan_summary(plan_captures(spark, sf_dir))
    return found.withColumns({"seq_scans": F.array_join("seq_scans", ","), "disk_sorts": F.array_join("disk_sorts", ",")})


def capture_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans, and for some the logs, of each customer's first and last order, as the sides of a comparison."""
    plans = captures.plan_summary(plan_captures(spark, sf_dir))
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    side = lambda n: plans.select(F.col("capture_id").alias(n), F.struct(*[c for c in plans.columns if c != "capture_id"]).alias(f"_{n}"))
    both = ends.join(side("first"), "first", "left").join(side("last"), "last", "left")
    gains, losses = captures.plan_changes("_first", "_last")
    told = both.select("*", gains.alias("gains"), losses.alias("losses"))
    logged = F.col("o_custkey") % 3 == 0
    log = lambda n: F.when(logged, F.col(f"_{n}.nodes"))
    category = F.when(F.col("o_custkey") % 2 == 0, "n-plus-one").otherwise("missing-index")
    said = captures.verdict(category, (log("first"), log("last")), (F.col("_first").isNotNull(), F.col("_last").isNotNull()), F.col("gains"), F.col("losses"))
    return told.select("o_custkey", F.array_join("gains", ",").alias("gains"), F.array_join("losses", ",").alias("losses"), said.alias("verdict"))


def catalog_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, raw): a catalog for each part, in one of five forms or none."""
    k, s = F.col("p_partkey"), F.col("p_size")
    tab = _text("T", s % 10)
    forms = [
        _text(" indexname | indexdef\n---\n CREATE UNIQUE INDEX ix_", k, " ON public.", tab, ' USING btree (a, lower("b"), coalesce(c, (0)))\n CREATE INDEX iy_', k, ' ON "', tab, '" USING gin (d) WHERE (d > 0)\n(2 rows)'),
        _text("| Table | Non_unique | Key_name | Seq_in_index | Column_name |\n+---+---+---+---+---+\n| ", tab, " | 0 | PRIMARY | 1 | id |\n| ", tab, " | 1 | ix_", k, " | 1 | a |\n| ", tab, " | 1 | ix_", k, " | 2 | b |\n| ragged | row |").alias("x"),
        _text("tablename | attname | n_distinct | null_frac\n---+---+---+---\n ", tab, " | a | ", s, " | 0.5\n ", tab, " | b | -1 | n/a\n(2 rows)"),
        _text("relname\tseq_scan\tidx_scan\tn_live_tup\n", tab, "\t5\t", k, "\t", s * 100),
        _text("relname,indexrelname,idx_scan\n", tab, ",ix_", k, ",", k),
        F.lit("nothing to read here"),
    ]
    return table(spark, sf_dir, "part").select(k.alias("capture_id"), F.get(F.array(*forms), (k % 6).cast("int")).alias("raw"))


def catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures.observed_indexes(captures.catalogs(catalog_captures(spark, sf_dir)))
    return found.withColumn("cols", F.array_join("cols", "|"))


def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of columns and tables, one below the other."""
    read = captures.catalogs(catalog_captures(spark, sf_dir))
    columns = captures.observed_columns(read).select("capture_id", "tab", "col", F.col("distinct").alias("a"), F.col("null_fraction").alias("b"))
    return columns.unionByName(captures.observed_tables(read).select("capture_id", "tab", F.lit("*").alias("col"), F.col("live_rows").cast("double").alias("a"), F.col("index_scans").cast("double").alias("b")))


def unknowable_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many captures leave each fact open."""
    return captures.unknowable_left(captures.catalogs(catalog_captures(spark, sf_dir))).groupBy("fact").agg(F.count("*").alias("n"))


def observed_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes that suppliers propose, against all that the parts' catalogs show."""
    read = captures.catalogs(catalog_captures(spark, sf_dir))
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cols = F.when(k % 4 == 0, F.array(F.lit("A"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 2, F.array(F.lit("zz"))).otherwise(F.array(F.lit("d")))
    proposed = s.select(k.alias("id"), F.concat(F.lit("t"), (k % 12).cast("string")).alias("tab"), cols.alias("cols"))
    indexes = captures.observed_indexes(read).withColumn("ord", F.col("capture_id") * 10 + F.col("ord"))
    return captures.against_observed(proposed, indexes, captures.observed_columns(read), captures.observed_tables(read))


def log_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, raw): a log for each customer, a statement an order, in one of four forms, as broken JSON, or without a statement."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 6
    sql = _text("SELECT a FROM t", F.col("o_orderkey") % 2, " WHERE id = ", F.col("o_orderkey"))
    line = F.when(k == 0, _text('{"sql": "', sql, '", "time": "0.001"}')).when(k == 1, _text("prisma:query ", sql)).when(k == 2, _text("  Order Load (1.5ms)  ", sql)).when(k == 3, sql).when(k == 4, sql).otherwise("  hello")
    per = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]).alias("l"))
    raw = F.when(k == 0, _text("[", F.array_join("l", ", "), "]")).when(k == 4, _text("[{", F.array_join("l", ", "))).otherwise(F.array_join("l", "\n"))
    return per.select(F.col("o_custkey").alias("capture_id"), raw.alias("raw"))


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.query_logs(log_captures(spark, sf_dir)).select("capture_id", "form", F.size(F.coalesce("statements", F.array().cast("array<string>"))).alias("n"), "total_ms")


def log_capture_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.log_shapes(captures.query_logs(log_captures(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (plan_nodes, odd_plan_nodes, plan_summaries, capture_verdicts, catalog_indexes, catalog_statistics, unknowable_left, observed_advice, query_logs, log_capture_shapes)}
_PLANS = """(SELECT l_orderkey AS capture_id, count(*) + 1 AS nodes, CAST(sum(l_linenumber) AS BIGINT) AS blocks_read, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS blocks_hit, CAST(sum(l_suppkey) AS BIGINT) AS rows_removed,
    array_to_string(list_sort(list_distinct(list('t' || (l_partkey % 5)))), ',') AS seq_scans, CASE WHEN l_orderkey % 2 = 0 THEN 'external merge Disk: 10kB' ELSE 'external merge  Disk: 10kB' END AS disk_sorts, true AS buffers, true AS timed,
    count(*) + 0.75e0 AS root_ms, count(*) + 0.25e0 AS total_ms, 0.5e0 AS planning_ms FROM lineitem GROUP BY 1)"""
_CATALOG = "(SELECT p_partkey AS k, p_partkey % 6 AS f, 'T' || (p_size % 10) AS tab, p_size AS s FROM part)"
_INDEXES = f"""(SELECT k AS capture_id, tab, 'ix_' || k AS name, 'a|lower(b)|coalesce(c, (0))' AS cols, true AS uniq, CAST(NULL AS BIGINT) AS scans, CAST(NULL AS BIGINT) AS size_bytes, 0 AS ord FROM {_CATALOG} c WHERE f = 0 UNION ALL SELECT k, tab, 'iy_' || k, 'd', false, NULL, NULL, 1 FROM {_CATALOG} c WHERE f = 0
    UNION ALL SELECT k, tab, 'PRIMARY', 'id', true, NULL, NULL, 0 FROM {_CATALOG} c WHERE f = 1 UNION ALL SELECT k, tab, 'ix_' || k, 'a|b', false, NULL, NULL, 1 FROM {_CATALOG} c WHERE f = 1 UNION ALL SELECT k, tab, 'ix_' || k, '', false, k, NULL, 0 FROM {_CATALOG} c WHERE f = 4)"""
ORACLE_SQL = {
    "plan_nodes": """SELECT l_orderkey AS capture_id, false AS root, 'Seq Scan' AS node_type, 't' || (l_partkey % 5) AS relation, CAST(l_quantity AS BIGINT) AS estimated_rows, CAST(CAST(l_quantity AS INTEGER) * (l_suppkey % 3 + 1) AS DOUBLE) AS actual_rows,
          (l_linenumber + 0.5e0) * (l_suppkey % 3 + 1) AS total_ms, CAST(l_suppkey % 3 + 1 AS BIGINT) AS loops, CAST(l_quantity AS BIGINT) AS blocks_hit, CAST(l_linenumber AS BIGINT) AS blocks_read, CAST(l_suppkey AS BIGINT) AS rows_removed, CAST(NULL AS VARCHAR) AS sort_method FROM lineitem
        UNION ALL SELECT l_orderkey, true, 'Sort', NULL, count(*), CAST(count(*) AS DOUBLE), count(*) + 0.75e0, 1, NULL, NULL, NULL, CASE WHEN l_orderkey % 2 = 0 THEN 'external merge Disk: 10kB' ELSE 'external merge  Disk: 10kB' END FROM lineitem GROUP BY 1""",
    "odd_plan_nodes": """SELECT k AS capture_id, CAST(node AS INTEGER) AS node, node_type, CASE WHEN by_key THEN relation || k ELSE relation END AS relation, CASE WHEN m IN (0, 4, 5) THEN k END AS estimated_rows, CAST(actual_rows AS DOUBLE) AS actual_rows, CAST(loops AS BIGINT) AS loops
        FROM (SELECT o_orderkey AS k, o_orderkey % 7 AS m FROM orders) o JOIN (VALUES (0, 0, 'Seq Scan', 'a', true, NULL, NULL), (3, 0, '5', NULL, false, NULL, NULL), (3, 1, 'Hash', NULL, false, 6, 3), (3, 2, 'Unknown', 'i', true, NULL, NULL), (4, 0, 'Seq Scan', 't', true, NULL, NULL), (5, 0, 'Seq Scan', 'u', false, NULL, NULL)) v(m, node, node_type, relation, by_key, actual_rows, loops) USING (m)""",
    "plan_summaries": f"SELECT * FROM {_PLANS} p",
    "capture_verdicts": f"""WITH e AS (SELECT o_custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1), p AS (SELECT * FROM {_PLANS} p),
        j AS (SELECT o_custkey, x.nodes AS na, y.nodes AS nb, x.capture_id IS NOT NULL AND y.capture_id IS NOT NULL AS plans,
          CASE WHEN x.blocks_read < 10 AND y.blocks_read < 10 THEN NULL ELSE (y.blocks_read - x.blocks_read) / CAST(x.blocks_read AS DOUBLE) END AS cb, CASE WHEN x.total_ms < 10 AND y.total_ms < 10 THEN NULL ELSE (y.total_ms - x.total_ms) / x.total_ms END AS ct
          FROM e LEFT JOIN p x ON x.capture_id = e.a LEFT JOIN p y ON y.capture_id = e.b),
        g AS (SELECT *, concat_ws(',', CASE WHEN cb <= -0.2e0 THEN 'blocks' END, CASE WHEN ct <= -0.2e0 THEN 'time' END) AS gains, concat_ws(',', CASE WHEN cb >= 0.2e0 THEN 'blocks' END, CASE WHEN ct >= 0.2e0 THEN 'time' END) AS losses FROM j)
        SELECT o_custkey, gains, losses, CASE WHEN o_custkey % 3 = 0 AND na IS NOT NULL AND nb IS NOT NULL THEN CASE WHEN nb > na THEN 'regression' WHEN nb = na THEN 'no-difference' ELSE 'confirmed' END WHEN o_custkey % 2 = 0 THEN 'insufficient-evidence'
          WHEN plans THEN CASE WHEN losses <> '' THEN 'regression' WHEN gains <> '' THEN 'confirmed' ELSE 'no-difference' END ELSE 'insufficient-evidence' END AS verdict FROM g""",
    "catalog_indexes": f"SELECT * FROM {_INDEXES} i",
    "catalog_statistics": f"""SELECT k AS capture_id, tab, 'a' AS col, CAST(s AS DOUBLE) AS a, 0.5e0 AS b FROM {_CATALOG} c WHERE f = 2 UNION ALL SELECT k, tab, 'b', -1.0e0, NULL FROM {_CATALOG} c WHERE f = 2 UNION ALL SELECT k, tab, '*', CAST(s * 100 AS DOUBLE), CAST(k AS DOUBLE) FROM {_CATALOG} c WHERE f = 3""",
    "unknowable_left": f"""SELECT fact, n FROM (SELECT count(*) FILTER (WHERE f <> 3) AS r, count(*) FILTER (WHERE f <> 2) AS s, count(*) FILTER (WHERE f NOT IN (0, 1, 4)) AS i, count(*) FILTER (WHERE f <> 4) AS b FROM {_CATALOG} c),
        LATERAL (VALUES ('Row counts', r), ('Column selectivity', s), ('Which indexes actually exist', i), ('Index bloat', b)) v(fact, n)""",
    "observed_advice": f"""WITH p AS (SELECT s_suppkey AS id, 't' || (s_suppkey % 12) AS tab, CASE s_suppkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a|b' WHEN 2 THEN 'zz' ELSE 'd' END AS cols FROM supplier), i AS (SELECT lower(tab) AS tab, name, cols, capture_id * 10 + ord AS ord FROM {_INDEXES} i),
        seen AS (SELECT DISTINCT lower(tab) AS tab FROM {_CATALOG} c WHERE f < 5), m AS (SELECT p.id, i.name, i.cols <> p.cols AS longer, i.ord FROM p JOIN i ON i.tab = p.tab AND (i.cols = p.cols OR starts_with(i.cols, p.cols || '|'))),
        b AS (SELECT id, arg_min(name, (longer, ord)) AS name, min(longer) AS longer FROM m GROUP BY 1), d AS (SELECT lower(tab) AS tab, min(s) AS n FROM {_CATALOG} c WHERE f = 2 GROUP BY 1), r AS (SELECT lower(tab) AS tab, min(s * 100) AS n FROM {_CATALOG} c WHERE f = 3 GROUP BY 1)
        SELECT p.id, seen.tab IS NOT NULL AS observed, b.name AS existing, CASE WHEN b.longer THEN 'covering' WHEN NOT b.longer THEN 'exact' END AS how, coalesce(b.id IS NULL AND seen.tab IS NOT NULL AND p.cols IN ('a', 'a|b') AND d.n BETWEEN 1 AND 10, false) AS low_distinct,
          coalesce(b.id IS NULL AND seen.tab IS NOT NULL AND r.n < 1000, false) AS small_table FROM p LEFT JOIN seen ON seen.tab = p.tab LEFT JOIN b ON b.id = p.id LEFT JOIN d ON d.tab = p.tab LEFT JOIN r ON r.tab = p.tab""",
    "query_logs": """SELECT o_custkey AS capture_id, CASE o_custkey % 6 WHEN 0 THEN 'django' WHEN 1 THEN 'prisma' WHEN 2 THEN 'rails' WHEN 3 THEN 'plain' WHEN 4 THEN 'unreadable' END AS form, CASE WHEN o_custkey % 6 < 4 THEN CAST(count(*) AS INTEGER) ELSE 0 END AS n,
        CASE o_custkey % 6 WHEN 0 THEN round(count(*) * 1.0e0, 1) WHEN 2 THEN round(count(*) * 1.5e0, 1) END AS total_ms FROM orders GROUP BY o_custkey""",
    "log_capture_shapes": "SELECT o_custkey AS capture_id, 'SELECT a FROM t' || (o_orderkey % 2) || ' WHERE id = ?' AS shape, count(*) AS n FROM orders WHERE o_custkey % 6 < 4 GROUP BY 1, 2",
}
