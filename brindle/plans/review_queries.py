"""Queries that join, compare and judge: catalogs, evidence, findings and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.shapes import normalise_shape
from brindle.functions.statements import equivalence, with_sql_shapes
from brindle.operators import evidence, gate, matching, metrics, profile, ranking
from brindle.plans.log_queries import _STATEMENTS, _sql_shape, statements
from brindle.sources import files
from brindle.tables import table

NOW, HEAD = "2024-01-20 00:00:00", 3


def log_shapes_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes by how often they run, ties by where they were first seen; the top 20 is the feature."""
    s = statements(spark, sf_dir).withColumn("sql", F.concat(F.col("sql"), F.lit(" AND g"), (F.col("o_orderkey") % 7).cast("string"), F.lit(" = 1")))
    return evidence.shape_counts(s.withColumn("shape", normalise_shape(F.col("sql"))), [], "shape", "o_orderkey").orderBy(F.col("n").desc(), "first_seen").limit(20).select("shape", "n", "first_seen", "repeated")


def n_plus_one_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir).withColumn("shape", normalise_shape(F.col("sql")))
    counts = evidence.shape_counts(s, ["o_custkey"], "shape", "o_orderkey")
    return counts.groupBy("o_custkey").agg(F.sum("n").alias("statements"), F.max("n").alias("most"), F.bool_or("repeated").alias("flagged"))


_SIX = ("redis", "solr", "postgres", "mariadb", "mysql", "duckdb")


def engine_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.lower(F.element_at(F.split("p_type", " "), -1)).alias("engine"), (F.lit(100) - F.col("p_size") % 4 * 10).cast("int").alias("authority"), F.col("p_partkey").alias("ord"))
    return profile.engine_profile(p, "engine", "authority", "ord")


def auxiliary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declarations of six engines: only caches and search engines have the highest authority, and the first of them is the primary engine."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.get(F.array(*[F.lit(e) for e in _SIX]), (k % 6).cast("int")).alias("engine"), F.when(k % 6 < 2, 100).otherwise(90 - F.col("p_size") % 2 * 10).cast("int").alias("authority"), k.alias("ord"))
    return profile.engine_profile(p, "engine", "authority", "ord")


def pick_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = F.split("p_type", " ")
    k = F.col("p_partkey")
    dialect, by_path = F.when(k % 7 == 0, F.lower(F.get(words, F.lit(0)))), F.when(k % 5 == 0, F.lower("p_brand"))
    named = F.when(k % 3 != 0, F.lower(F.element_at(words, -1)))
    return p.select("p_partkey", profile.pick_engine(dialect, by_path, named, F.col("p_size") > 25, F.lit("postgres"), k % 2 == 0).alias("engine"))


def tier_two_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, seen as files, that no pending order, seen as a site, covers."""
    covered = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(covered, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def changed_scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites in changed files only: orders of customers of one segment, committed, and of another one, in the working copy, of which some are removed."""
    c = table(spark, sf_dir, "customer").withColumn("path", F.col("c_custkey"))
    committed = c.filter("c_mktsegment = 'BUILDING'").select("path", F.lit("modified").alias("status"))
    dirty = c.filter("c_mktsegment = 'MACHINERY'").select("path", F.when(F.col("c_custkey") % 2 == 0, "removed").otherwise("added").alias("status"))
    sites = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("path"))
    return files.changed(sites, committed, dirty).select("o_orderkey", F.col("path").alias("o_custkey"))


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("T"), (F.col("p_size") % 10).cast("string")).alias("tab"), F.slice(words, 1, (F.col("p_partkey") % 3 + 1).cast("int")).alias("cols"), (F.col("p_partkey") % 4 == 0).alias("uniq"))


_INDEXES = "(SELECT p_partkey AS id, 'T' || (p_size % 10) AS tab, string_split(p_name || ' ' || p_type, ' ')[1:CAST(p_partkey % 3 + 1 AS INTEGER)] AS cols, p_partkey % 4 = 0 AS uniq FROM part)"


def index_prefix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.prefix_covers(_indexes(spark, sf_dir), "tab", "cols", "id", "uniq")


def catalog_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as declared indexes, suppliers' nations as observed ones."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("trade").alias("tab"), F.concat(F.lit("ix_"), F.lower("n_name")).alias("name"), F.array(F.col("n_nationkey").cast("string")).alias("cols"))
    s = table(spark, sf_dir, "supplier").filter("s_nationkey % 2 = 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("id"))
    observed = s.select(F.col("id"), F.lit("TRADE").alias("tab"), F.concat(F.lit("obs_"), F.col("s_nationkey").cast("string")).alias("name"), F.array(F.when(F.col("s_nationkey") < 10, F.col("s_nationkey").cast("string")).otherwise("-")).alias("cols"))
    merged = matching.merged_catalogs(n, observed, "tab", "name", "cols", "id")
    return merged.select(F.lower("tab").alias("tab"), "name", F.array_join("cols", ",").alias("cols"), "origin")


def grounded_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declared indexes, customers as observed ones, with statistics by supplier and nation: several declared indexes want one observed, by name or by columns."""
    of = lambda k, cell: F.array(cell(k % 7), cell(k % 3))
    lower, upper = (lambda n: F.concat(F.lit("c"), n.cast("string"))), (lambda n: F.concat(F.lit('"C'), n.cast("string"), F.lit('"')))
    p, c, n = F.col("p_partkey"), F.col("c_custkey"), F.col("n_nationkey")
    tab = lambda k, size: F.concat(F.lit("t"), (k % size).cast("string"))
    declared = table(spark, sf_dir, "part").select(p.alias("id"), tab(p, 50).alias("tab"), F.concat(F.lit("IX_"), p.cast("string")).alias("name"), of(p, lower).alias("cols"), (p % 2 == 0).alias("uniq"))
    name = F.when(c % 3 == 0, F.concat(F.lit("`ix_"), c.cast("string"), F.lit("`"))).otherwise(F.concat(F.lit("obs_"), (c % 40).cast("string")))
    observed = table(spark, sf_dir, "customer").select(F.upper(tab(c, 50)).alias("tab"), name.alias("name"), F.when(c % 3 == 2, F.array().cast("array<string>")).otherwise(of(c, upper)).alias("cols"), F.lit(False).alias("uniq"), c.alias("scans"), F.lit(None).cast("long").alias("size_bytes"), c.alias("ord"))
    tables = table(spark, sf_dir, "supplier").select(tab(F.col("s_suppkey"), 60).alias("tab"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey")).alias("live_rows"))
    columns = table(spark, sf_dir, "nation").select(tab(n, 25).alias("tab"), lower(n % 7).alias("col"), n.cast("double").alias("distinct"), F.lit(0.5).alias("null_fraction"), F.lit(None).cast("double").alias("width"))
    found = matching.grounded_catalog(declared, observed, tables, columns)
    return found.select("tab", "name", F.array_join("cols", ",").alias("cols"), "uniq", "origin", "scans", "observed", "live_rows", "distinct", "null_fraction")


def merge_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation the first balance and the first segment that is not null, suppliers before customers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("balance"), F.lit(None).cast("string").alias("segment"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") + 1_000_000_000).alias("ord"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return matching.coalesced(s.unionByName(c), ["nation"], "ord", ["balance", "segment"])


def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings against suppliers as labelled defects: same file, at most three lines apart. Both semi-joins and the pairs, per file."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("file"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("line"), "o_orderkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("file"), F.floor(F.abs("s_acctbal") / 2).cast("long").alias("at"), "s_suppkey")
    pairs = matching.tolerance_join(o, s, ["file"], "line", "at", 3)
    return pairs.groupBy("file").agg(F.count("*").alias("pairs"), F.count_distinct("o_orderkey").alias("real"), F.count_distinct("s_suppkey").alias("found"))


def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's closest order within six lines."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("file"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("line"), "o_orderkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("file"), F.floor(F.abs("s_acctbal") / 2).cast("long").alias("at"), "s_suppkey")
    return matching.nearest_within(s, o, ["file"], "at", "line", 6, ["s_suppkey"], ["o_orderkey"]).select("s_suppkey", "o_orderkey")


def authored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that each supplier is about: a third of them name one, some of which are not there; the others cite a file and a line."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("file"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("line"), "o_orderkey")
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("file"), F.floor(F.abs("s_acctbal") / 2).cast("long").alias("at"), "s_suppkey", F.when(k % 3 == 0, F.when(k % 2 == 0, k + 1).otherwise(-k)).alias("claimed"))
    return matching.authored_sites(s, o, ["file"], "at", "line", 6, "s_suppkey", "claimed", "o_orderkey")


def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts as models: a brand with a date, a channel, both, another kind's name, or nothing after it."""
    k = F.col("p_partkey") % 6
    suffix = F.when(k == 0, "-20250929").when(k == 1, "-latest").when(k == 2, "-2024-05-13").when(k == 3, "-mini").when(k == 4, "@20250101-preview").otherwise("")
    models = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", suffix).alias("model"))
    prices = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("base")).agg(F.max("p_size").cast("long").alias("price"))
    return matching.price_for(models, prices).select("p_partkey", "price")


def gate_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.headline(_findings(spark, sf_dir), "reason")


def reconcile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    answered = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return matching.reconciled(sent, answered, "id", "o_orderkey")


def triage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("sample", F.col("event_id") % 3)
    return profile.triage_support(e, "user_id", "sample", F.col("event_type") == "error")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    original = F.concat(F.lit("for x in y:  q("), F.col("o_custkey").cast("string"), F.lit(")"))
    fields = {
        "original": original,
        "proposed": F.when(k % 11 == 0, " ").when(k % 11 == 1, F.regexp_replace(original, " +", " ")).otherwise("q_in(y)"),
        "invented": k % 13 == 0,
        "data_access": k % 17 != 0,
        "category": F.when(k % 3 == 0, "n-plus-one").when(k % 3 == 1, "missing-index").otherwise("batching"),
        "count_a": (k % 4).cast("int"),
        "count_b": (k % 5).cast("int"),
        "leaves_loop": k % 2 == 0,
        "contradicted": k % 19 == 0,
        "trigger": F.when(F.col("o_orderstatus") == "F", "request-handler").when(F.col("o_orderstatus") == "P", "migration").otherwise("unknown"),
        "kind": F.when(k % 4 == 0, "behavioural").otherwise("equivalent"),
        "schema_object": k % 3 == 1,
        "questionable": k % 2 == 1,
        "counted": F.when(k % 7 == 0, F.array(F.lit("2 fewer columns"))).when(k % 7 < 4, F.array(F.lit("1 fewer column"), F.lit("Caps the result"))).otherwise(F.array().cast("array<string>")),
        "samples": F.lit(3),
        "flagged": (k % 4).cast("int"),
        "per_iteration": F.col("o_custkey") % 3 == 0,
    }
    f = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", *[c.alias(n) for n, c in fields.items()])
    cols = {n: F.col(n) for n in fields} | {"counted_n": F.size("counted")}
    level = gate.severity(cols)
    return f.select("o_orderkey", "kind", gate.suppression(cols).alias("reason"), gate.capped(level, k % 6 == 0, F.col("samples"), F.col("flagged"), F.size("counted")).alias("severity"))


_FINDINGS = """(SELECT o_orderkey, kind, CASE
    WHEN trim(proposed) = '' THEN 'no-op' WHEN trim(regexp_replace(original, '[ \\t\\r\\n]+', ' ', 'g')) = trim(regexp_replace(proposed, '[ \\t\\r\\n]+', ' ', 'g')) THEN 'no-op'
    WHEN k % 13 = 0 THEN 'invented-symbol' WHEN k % 17 = 0 THEN 'not-data-access'
    WHEN category IN ('n-plus-one', 'batching') AND (k % 4 > 0 OR k % 5 > 0) AND k % 5 >= k % 4 AND k % 2 <> 0 THEN 'wrong-direction'
    WHEN k % 19 = 0 THEN 'unsupported-assumption' WHEN trigger = 'migration' AND kind = 'equivalent' AND NOT schema_object THEN 'cold-path'
    WHEN k % 2 = 1 AND k % 7 >= 4 AND (k % 4) / 3.0e0 < 0.5e0 THEN 'unsupported-speculation'
    WHEN k % 7 = 0 AND NOT per_iteration AND NOT schema_object THEN 'immaterial' END AS reason,
  CASE WHEN (k % 4) / 3.0e0 < 0.5e0 AND n = 0 AND cited = 'high' THEN 'medium' WHEN (k % 4) / 3.0e0 < 0.5e0 AND n = 0 AND cited = 'medium' THEN 'low' ELSE cited END AS severity
  FROM (SELECT *, CASE WHEN k % 6 = 0 AND level IN ('high', 'medium') THEN 'low' ELSE level END AS cited FROM (SELECT *, CASE
      WHEN NOT schema_object AND trigger = 'migration' THEN 'info' WHEN per_iteration AND trigger = 'request-handler' THEN CASE WHEN n > 0 THEN 'high' ELSE 'medium' END
      WHEN per_iteration THEN CASE WHEN n > 0 THEN 'medium' ELSE 'low' END WHEN category = 'n-plus-one' THEN 'low' WHEN schema_object THEN CASE WHEN n > 0 THEN 'medium' ELSE 'low' END WHEN n = 0 THEN 'low' ELSE 'medium' END AS level
    FROM (SELECT o_orderkey, o_orderkey AS k, original, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 11 = 1 THEN regexp_replace(original, ' +', ' ', 'g') ELSE 'q_in(y)' END AS proposed,
        CASE o_orderkey % 3 WHEN 0 THEN 'n-plus-one' WHEN 1 THEN 'missing-index' ELSE 'batching' END AS category, CASE o_orderstatus WHEN 'F' THEN 'request-handler' WHEN 'P' THEN 'migration' ELSE 'unknown' END AS trigger,
        CASE WHEN o_orderkey % 4 = 0 THEN 'behavioural' ELSE 'equivalent' END AS kind, o_orderkey % 3 = 1 AS schema_object, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 7 < 4 THEN 2 ELSE 0 END AS n, o_custkey % 3 = 0 AS per_iteration
      FROM (SELECT *, 'for x in y:  q(' || o_custkey || ')' AS original FROM orders)))))"""


def gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.reason_counts(_findings(spark, sf_dir).filter("reason IS NOT NULL"), "reason")


def judged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("o_orderkey", F.coalesce("reason", F.lit("published")).alias("outcome"), F.when(F.col("reason").isin("cold-path", "immaterial"), "info").otherwise(F.col("severity")).alias("severity"))


def severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.severity_matrix(_findings(spark, sf_dir).filter("reason IS NULL"), "severity", "kind", ["equivalent", "behavioural"])


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp"))
    s = evidence.staleness(at, F.col("user_id") % 4, F.lit(NOW).cast("timestamp"), F.lit(HEAD))
    return e.select("event_id", s.alias("state"))


def side_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines of a part against accepted ones, as the plans before and after."""
    li = table(spark, sf_dir, "lineitem")
    both = evidence.sides(li, "l_partkey", "l_returnflag", "R", "A", {"n": F.lit(1), "blocks": F.col("l_quantity").cast("long"), "ms": F.round(F.col("l_discount") * 100).cast("long")})
    change = lambda m: evidence.relative_change(F.col(f"{m}_a"), F.col(f"{m}_b"))
    return both.select("l_partkey", evidence.log_verdict(F.col("n_a"), F.col("n_b")).alias("by_log"), evidence.plan_verdict([change("blocks"), change("ms")]).alias("by_plan"), F.round(change("blocks"), 4).alias("blocks"))


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as nodes of their order's plan."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Seq Scan").when(F.col("l_linenumber") % 3 == 1, "Index Scan").otherwise("Sort")
    nodes = li.select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("node_id"), kind.alias("node_type"), F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("relation"), F.col("l_suppkey").alias("rows_removed"),
                      F.col("l_quantity").cast("long").alias("blocks_read"), F.when(F.col("l_tax") > 0.04, F.col("l_quantity").cast("long")).alias("blocks_hit"))
    t = evidence.plan_totals(nodes)
    return t.withColumns({"node_types": F.array_join("node_types", ","), "seq_scans": F.array_join("seq_scans", ",")})


def bench_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    r = lambda test: metrics.ratio(F.sum(test.cast("long")), F.count("*"))
    runs = li.groupBy("l_returnflag", "l_linenumber").agg(r(F.col("l_discount") > 0.05).alias("precision"), r(F.col("l_quantity") > 25).alias("recall"), metrics.ratio(F.sum((F.col("l_tax") > 0.07).cast("long")), F.sum((F.col("l_quantity") > 49).cast("long"))).alias("coverage"))
    return metrics.summary(runs, ["l_returnflag"], ["precision", "recall", "coverage"])


def bench_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = bench_metrics(spark, sf_dir).groupBy("metric").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = spark.createDataFrame([("precision", "least", 0.4), ("recall", "most", 0.4), ("absent", "least", 0.1)], "metric string, side string, bound double")
    return metrics.gates(worst, bounds)


def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = F.split("p_type", " ")
    other = F.when(F.col("p_partkey") % 3 == 0, F.reverse(words)).when(F.col("p_partkey") % 3 == 1, F.transform(words, lambda w: F.concat(F.lit('"'), F.lower(w), F.lit('"')))).otherwise(F.concat(words, F.slice(words, 1, 1)))
    return p.select("p_partkey", matching.same_set(words, other).alias("same"), F.size(F.array_except(other, words)).cast("long").alias("added"))


def projection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that come and go between two lists written in other cases and quotes."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_type", " ")
    other = F.when(F.col("p_partkey") % 3 == 0, F.transform(F.slice(words, 2, 2), F.lower)).when(F.col("p_partkey") % 3 == 1, F.concat(F.transform(words, lambda w: F.concat(F.lit("`"), w, F.lit("`"))), F.array("p_brand"))).otherwise(F.array("p_brand", "p_brand"))
    told = p.select("p_partkey", matching.set_changes(words, other).alias("c"))
    return told.select("p_partkey", F.array_join("c.added", ",").alias("added"), F.array_join("c.removed", ",").alias("removed"))


def truth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as truths, purchases as findings, purchases and sign-ups as candidates, of one user within two hours."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"))
    of = lambda *kinds: e.filter(F.col("event_type").isin(*kinds))
    told = matching.found_both_ways(of("purchase"), of("error"), of("purchase", "signup"), ["user_id"], "at", 7200)
    parts = [rows.select(F.lit(name).alias("side"), "event_id") for name, rows in told.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def author_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests about customers, some asked twice; those with a finished order are answered."""
    o = table(spark, sf_dir, "orders")
    sent = o.select(F.col("o_custkey").alias("site"), (F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1)).alias("attempt"))
    return matching.next_requests(sent, o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("site")), "site", "attempt")


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as passes of their users' runs, some not ended."""
    at = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("user_id", at.alias("started"), F.when(F.col("event_id") % 5 > 0, at + F.expr("INTERVAL 90 SECONDS")).alias("ended"), (F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 10).alias("output_tokens"))
    return ranking.run_totals(e, ["user_id"])


def price_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#17'").select(F.col("p_brand").alias("prefix"), F.col("p_size").cast("long").alias("price")).groupBy("prefix").agg(F.max("price").alias("price"))
    short = prices.select(F.substring("prefix", 1, 7).alias("prefix"), "price").groupBy("prefix").agg((F.max("price") + 1000).alias("price"))
    models = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("-2024")).alias("model"))
    return matching.longest_prefix(models, prices.join(short, "prefix", "left_anti").unionByName(short), "model", "prefix", "price").select("p_partkey", "price")


def statement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, a, b): a statement for each order, and a rewrite of it."""
    k = F.col("o_orderkey")
    a = F.concat(F.lit("SELECT a, b, max(coalesce(c, (0))) FROM t JOIN u ON t.x = u.x WHERE k = "), k.cast("string"), F.lit(" AND n = 'it''s, (x) -- \\' y' GROUP BY a, b ORDER BY a ASC, b -- done"))
    dml = F.concat(F.lit("UPDATE t SET a = (SELECT 1 WHERE 2 = 2) WHERE k = "), k.cast("string"))
    first = F.when(k % 16 == 8, dml).when(k % 16 == 9, dml).when(k % 16 == 10, "CREATE INDEX i ON t (a)").when(k % 16 == 11, " ").otherwise(a)
    b = (
        F.when(k % 16 == 0, F.lower(F.concat(F.replace(a, F.lit("AND n"), F.lit("and n")), F.lit("\n"))))
        .when(k % 16 == 1, F.replace(a, F.lit("a, b, max(coalesce(c, (0)))"), F.lit("*")))
        .when(k % 16 == 2, F.replace(a, F.lit(" -- done"), F.lit(" LIMIT 10")))
        .when(k % 16 == 3, F.replace(a, F.lit("SELECT a"), F.lit("SELECT DISTINCT a")))
        .when(k % 16 == 4, F.replace(a, F.lit("k = "), F.lit("k >= ")))
        .when(k % 16 == 5, F.lit("DELETE FROM t WHERE k = 1"))
        .when(k % 16 == 6, F.replace(a, F.lit(" GROUP BY"), F.lit(" /* from x */ GROUP  BY")))
        .when(k % 16 == 7, F.lit("q.filter(k=1)"))
        .when(k % 16 == 8, F.replace(dml, F.lit("SELECT 1"), F.lit("SELECT 3")))
        .when(k % 16 == 9, F.concat(dml, F.lit(" AND b > 0")))
        .when(k % 16 == 10, F.lit("drop index i"))
        .when(k % 16 == 12, F.replace(a, F.lit("(0)"), F.lit("(1)")))
        .when(k % 16 == 13, F.replace(a, F.lit("SELECT a"), F.lit("SELECT TOP 5 a")))
        .when(k % 16 == 14, F.concat(F.replace(a, F.lit(" -- done"), F.lit("")), F.lit(" UNION SELECT 1, 2, 3 FROM v")))
        .otherwise(a)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("a"), b.alias("b"))


def sql_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_sql_shapes(statement_pairs(spark, sf_dir), sa=F.col("a"), sb=F.col("b")).select("o_orderkey", "sb", equivalence(F.col("sa"), F.col("sb")).alias("e"))
    return p.select("o_orderkey", "e.status", F.array_join(F.concat("e.hard", "e.soft", "e.undecided"), "+").alias("deltas"), F.coalesce("sb.kind", F.lit("-")).alias("kind"), F.array_join("sb.projection", "|").alias("projection"), F.col("sb.joins").cast("long").alias("joins"))


def vocabulary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names that no part type has."""
    p = table(spark, sf_dir, "part")
    names = p.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    types = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
    return gate.unknown_names(names, types, "word", p, 25).groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (log_shapes_top20, n_plus_one_flags, engine_profile, auxiliary_profile, projection_changes, truth_coverage, author_retries, run_totals, pick_engine, tier_two_anti, changed_scope_semi, index_prefix_cover, catalog_full_outer, grounded_catalog, merge_catalogs, tolerance_match, nearest_site, authored_sites, model_prices, gate_headline, reconcile_ids, triage_support,
              gate_cascade, judged_findings, severity_matrix, staleness, side_compare, plan_totals, bench_metrics, bench_gates, set_equality, price_prefix, sql_equivalence, vocabulary_gap)
}
_SHAPED = f"(SELECT o_orderkey, o_custkey, {_sql_shape('sql')} AS shape FROM {_STATEMENTS} s)"
_METRICS = """(WITH r AS (SELECT l_returnflag, l_linenumber, round(sum(CASE WHEN l_discount > 0.05e0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS precision, round(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS recall,
    CASE WHEN sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) > 0 THEN round(sum(CASE WHEN l_tax > 0.07e0 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS DOUBLE), 4) END AS coverage FROM lineitem GROUP BY 1, 2),
  u AS (SELECT l_returnflag, 'precision' AS metric, precision AS value FROM r UNION ALL SELECT l_returnflag, 'recall', recall FROM r UNION ALL SELECT l_returnflag, 'coverage', coverage FROM r)
  SELECT l_returnflag, metric, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM u GROUP BY 1, 2)"""
_TOL = """(SELECT o_orderkey, o_custkey % 25 AS file, CAST(floor(o_totalprice / 100) AS BIGINT) AS line FROM orders) o JOIN (SELECT s_suppkey, s_nationkey AS file, CAST(floor(abs(s_acctbal) / 2) AS BIGINT) AS at_line FROM supplier) s ON o.file = s.file AND abs(line - at_line)"""
ORACLE_SQL = {
    "log_shapes_top20": f"SELECT {_sql_shape('sql')} AS shape, count(*) AS n, min(o_orderkey) AS first_seen, count(*) > 10 AS repeated FROM (SELECT o_orderkey, sql || ' AND g' || (o_orderkey % 7) || ' = 1' AS sql FROM {_STATEMENTS} x) s GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20",
    "n_plus_one_flags": f"SELECT o_custkey, CAST(sum(n) AS BIGINT) AS statements, max(n) AS most, bool_or(n > 10) AS flagged FROM (SELECT o_custkey, shape, count(*) AS n FROM {_SHAPED} s GROUP BY 1, 2) GROUP BY 1",
    "engine_profile": f"""WITH p AS (SELECT lower(list_extract(string_split(p_type, ' '), -1)) AS engine, CAST(100 - p_size % 4 * 10 AS INTEGER) AS authority, p_partkey AS ord FROM part), b AS (SELECT engine, max(authority) AS authority, min(ord) AS first_seen FROM p GROUP BY 1),
        s AS (SELECT * FROM b WHERE engine NOT IN ({', '.join(f"'{x}'" for x in profile.AUXILIARY)})), t AS (SELECT arg_min(engine, first_seen) AS prime, count(*) AS n FROM s WHERE authority = (SELECT max(authority) FROM s))
        SELECT engine, authority, first_seen, engine = (SELECT prime FROM t) AS primary, (SELECT n FROM t) > 1 AS ambiguous FROM b""",
    "auxiliary_profile": f"""WITH p AS (SELECT {list(_SIX)}[p_partkey % 6 + 1] AS engine, CAST(CASE WHEN p_partkey % 6 < 2 THEN 100 ELSE 90 - p_size % 2 * 10 END AS INTEGER) AS authority, p_partkey AS ord FROM part), b AS (SELECT engine, max(authority) AS authority, min(ord) AS first_seen FROM p GROUP BY 1)
        SELECT engine, authority, first_seen, engine = (SELECT arg_min(engine, first_seen) FROM b WHERE authority = 100) AS primary, false AS ambiguous FROM b""",
    "projection_changes": """WITH p AS (SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda w: lower(w)) AS a, replace(lower(p_brand), ' ', '') AS b FROM part),
        q AS (SELECT p_partkey, a, CASE p_partkey % 3 WHEN 0 THEN a[2:3] WHEN 1 THEN list_append(a, b) ELSE [b] END AS o FROM p)
        SELECT p_partkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(o, lambda x: NOT list_contains(a, x)))), ','), '') AS added, coalesce(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(o, x)))), ','), '') AS removed FROM q""",
    "truth_coverage": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events)
        SELECT 'real' AS side, event_id FROM e WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_type = 'error' AND abs(o.t - e.t) <= 7200)
        UNION ALL SELECT 'found', event_id FROM e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND abs(o.t - e.t) <= 7200)
        UNION ALL SELECT 'covered', event_id FROM e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_type IN ('purchase', 'signup') AND abs(o.t - e.t) <= 7200)""",
    "author_retries": "SELECT o_custkey AS site, CAST(2 AS INTEGER) AS attempt FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderkey % 7 = 0)",
    "run_totals": """SELECT user_id, count(*) AS passes, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(coalesce(sum(CASE WHEN event_id % 3 > 0 THEN event_id % 10 END), 0) AS BIGINT) AS output_tokens,
        CAST(floor(epoch_us(max(CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 90 SECOND ELSE ts END)) / 1000000) - floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS elapsed_seconds FROM events GROUP BY user_id""",
    "pick_engine": "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 = 0 THEN lower(string_split(p_type, ' ')[1]) END, CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand) END, CASE WHEN p_size > 25 AND p_partkey % 3 <> 0 THEN lower(list_extract(string_split(p_type, ' '), -1)) END, CASE WHEN p_partkey % 2 <> 0 THEN 'postgres' END, CASE WHEN p_partkey % 3 <> 0 THEN lower(list_extract(string_split(p_type, ' '), -1)) END, 'unknown') AS engine FROM part",
    "tier_two_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "changed_scope_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' AND c_custkey % 2 <> 0)",
    "index_prefix_cover": f"WITH i AS (SELECT * FROM {_INDEXES} x) SELECT a.id, min(b.id) AS covered_by FROM i a JOIN i b ON a.tab = b.tab AND len(b.cols) > len(a.cols) AND b.cols[1:len(a.cols)] = a.cols AND a.id <> b.id WHERE NOT a.uniq GROUP BY 1",
    "grounded_catalog": """WITH d AS (SELECT p_partkey AS k, 't' || (p_partkey % 50) AS t, 'IX_' || p_partkey AS name, 'c' || (p_partkey % 7) || ',c' || (p_partkey % 3) AS cols, p_partkey % 2 = 0 AS uniq FROM part),
        o AS (SELECT c_custkey AS k, 't' || (c_custkey % 50) AS t, CASE WHEN c_custkey % 3 = 0 THEN 'ix_' || c_custkey ELSE 'obs_' || (c_custkey % 40) END AS n, CASE WHEN c_custkey % 3 = 0 THEN '`ix_' || c_custkey || '`' ELSE 'obs_' || (c_custkey % 40) END AS name, CASE WHEN c_custkey % 3 <> 2 THEN '"C' || (c_custkey % 7) || '","C' || (c_custkey % 3) || '"' ELSE '' END AS cols FROM customer),
        m AS (SELECT d.k, min(o.k) AS ok FROM d JOIN o ON d.t = o.t AND (lower(d.name) = o.n OR d.cols = replace(lower(o.cols), '"', '')) GROUP BY d.k),
        every AS (SELECT d.t AS tab, coalesce(o.name, d.name) AS name, CASE WHEN o.cols <> '' THEN o.cols ELSE d.cols END AS cols, d.uniq, CASE WHEN o.k IS NULL THEN 'declared' ELSE 'both' END AS origin, o.k AS scans, d.t FROM d LEFT JOIN m ON m.k = d.k LEFT JOIN o ON o.k = m.ok
          UNION ALL SELECT upper(o.t), o.name, o.cols, false, 'observed', o.k, o.t FROM o WHERE NOT EXISTS (SELECT 1 FROM m JOIN o c ON c.k = m.ok WHERE c.t = o.t AND c.n = o.n))
        SELECT e.tab, e.name, e.cols, e.uniq, e.origin, e.scans, e.t IN (SELECT t FROM o UNION ALL SELECT 't' || (s_suppkey % 60) FROM supplier UNION ALL SELECT 't' || n_nationkey FROM nation) AS observed,
          (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 4 > 0 AND 't' || (s_suppkey % 60) = e.t) AS live_rows, CAST(n_nationkey AS DOUBLE) AS distinct, CASE WHEN n_nationkey IS NOT NULL THEN 0.5e0 END AS null_fraction
        FROM every e LEFT JOIN nation ON 't' || n_nationkey = e.t AND 'c' || (n_nationkey % 7) = replace(lower(split_part(e.cols, ',', 1)), '"', '')""",
    "catalog_full_outer": """WITH o AS (SELECT s_nationkey AS k FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) SELECT 'trade' AS tab, 'ix_' || lower(n_name) AS name, CAST(n_nationkey AS VARCHAR) AS cols, CASE WHEN n_nationkey < 10 AND n_nationkey IN (SELECT k FROM o) THEN 'both' ELSE 'declared' END AS origin FROM nation
        UNION ALL SELECT 'trade', 'obs_' || k, '-', 'observed' FROM o WHERE k >= 10 UNION ALL SELECT 'trade', 'obs_' || k, CAST(k AS VARCHAR), 'observed' FROM o WHERE k < 10 AND k NOT IN (SELECT n_nationkey FROM nation)""",
    "merge_catalogs": """WITH u AS (SELECT s_nationkey AS nation, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_nationkey, c_custkey + 1000000000, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END FROM customer)
        SELECT nation, arg_min(balance, ord) FILTER (WHERE balance IS NOT NULL) AS balance, arg_min(segment, ord) FILTER (WHERE segment IS NOT NULL) AS segment FROM u GROUP BY nation""",
    "tolerance_match": f"SELECT o.file, count(*) AS pairs, count(DISTINCT o_orderkey) AS real, count(DISTINCT s_suppkey) AS found FROM {_TOL} <= 3 GROUP BY 1",
    "nearest_site": f"SELECT x.s_suppkey, y.o_orderkey FROM supplier x LEFT JOIN (SELECT s_suppkey, o_orderkey FROM {_TOL} <= 6 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(line - at_line), o_orderkey) = 1) y ON x.s_suppkey = y.s_suppkey",
    "authored_sites": f"""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 ELSE -s_suppkey END END AS claimed FROM supplier),
        n AS (SELECT s_suppkey, o_orderkey FROM {_TOL} <= 6 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(line - at_line), o_orderkey) = 1)
        SELECT s.s_suppkey, coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey FROM s LEFT JOIN orders o ON o.o_orderkey = s.claimed LEFT JOIN n ON n.s_suppkey = s.s_suppkey""",
    "model_prices": "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 3 THEN b.price END AS price FROM part JOIN (SELECT p_brand, max(CAST(p_size AS BIGINT)) AS price FROM part GROUP BY 1) b USING (p_brand)",
    "gate_headline": f"""WITH r AS (SELECT reason, count(*) AS n FROM {_FINDINGS} f GROUP BY 1), o AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {k})" for k, r in enumerate(gate.REASONS))}) o(reason, k))
        SELECT (SELECT n FROM r WHERE reason IS NULL) AS published, CAST(sum(n) AS BIGINT) AS held, (SELECT n FROM r WHERE reason IS NULL) || ' published, ' || sum(n) || ' held back: ' || string_agg(n || ' ' || r.reason, ', ' ORDER BY k) AS headline FROM r JOIN o ON o.reason = r.reason""",
    "reconcile_ids": """WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT o_custkey AS id, min(o_orderkey) AS first_answer FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT coalesce(s.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'unaccounted' WHEN s.id IS NULL THEN 'invented' ELSE 'answered' END AS status, first_answer FROM s FULL JOIN a ON s.id = a.id""",
    "triage_support": """WITH p AS (SELECT user_id, event_id % 3 AS sample, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS f FROM events GROUP BY 1, 2), c AS (SELECT user_id, CAST(sum(f) AS BIGINT) AS flagged FROM p GROUP BY 1)
        SELECT user_id, flagged, (SELECT count(DISTINCT sample) FROM p) AS samples, round(flagged / CAST((SELECT count(DISTINCT sample) FROM p) AS DOUBLE), 4) AS share, CASE WHEN flagged > 0 THEN 'problem' ELSE 'clean' END AS verdict FROM c""",
    "gate_cascade": f"SELECT r.reason, count(f.reason) AS n FROM (SELECT unnest([{', '.join(f"'{r}'" for r in gate.REASONS)}]) AS reason) r LEFT JOIN {_FINDINGS} f ON f.reason = r.reason GROUP BY 1",
    "judged_findings": f"SELECT o_orderkey, coalesce(reason, 'published') AS outcome, CASE WHEN reason IN ('cold-path', 'immaterial') THEN 'info' ELSE severity END AS severity FROM {_FINDINGS} f",
    "severity_matrix": f"SELECT severity, count(*) FILTER (WHERE kind = 'equivalent') AS equivalent, count(*) FILTER (WHERE kind = 'behavioural') AS behavioural FROM {_FINDINGS} f WHERE reason IS NULL GROUP BY 1",
    "staleness": f"SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unreadable' WHEN a < -60 THEN 'future' WHEN user_id % 4 <> {HEAD} THEN 'other-commit' WHEN a > 604800 THEN 'old' ELSE 'fresh' END AS state FROM (SELECT *, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts)) AS a FROM events)",
    "side_compare": """WITH s AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 END) AS na, sum(CASE WHEN l_returnflag = 'A' THEN 1 END) AS nb, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS ba, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS bb,
          sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS BIGINT) END) AS ma, sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_discount * 100) AS BIGINT) END) AS mb FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1),
        c AS (SELECT *, CASE WHEN ba IS NULL OR bb IS NULL THEN NULL WHEN ba = 0 THEN CASE WHEN bb = 0 THEN 0.0e0 END WHEN ba < 10 AND bb < 10 THEN NULL ELSE (bb - ba) / CAST(ba AS DOUBLE) END AS cb, CASE WHEN ma IS NULL OR mb IS NULL THEN NULL WHEN ma = 0 THEN CASE WHEN mb = 0 THEN 0.0e0 END WHEN ma < 10 AND mb < 10 THEN NULL ELSE (mb - ma) / CAST(ma AS DOUBLE) END AS cm FROM s)
        SELECT l_partkey, CASE WHEN na IS NULL OR nb IS NULL THEN 'insufficient-evidence' WHEN nb > na THEN 'regression' WHEN nb = na THEN 'no-difference' ELSE 'confirmed' END AS by_log,
          CASE WHEN cb IS NULL AND cm IS NULL THEN 'insufficient-evidence' WHEN coalesce(cb > 0.2e0, false) OR coalesce(cm > 0.2e0, false) THEN 'regression' WHEN coalesce(cb < -0.2e0, false) OR coalesce(cm < -0.2e0, false) THEN 'confirmed' ELSE 'no-difference' END AS by_plan, round(cb, 4) AS blocks FROM c""",
    "plan_totals": """SELECT l_orderkey AS capture_id, count(*) AS nodes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS blocks_read, CAST(sum(CASE WHEN l_tax > 0.04e0 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS blocks_hit, CAST(sum(l_suppkey) AS BIGINT) AS rows_removed,
        array_to_string(list_sort(list_distinct(list(t))), ',') AS node_types, coalesce(array_to_string(list_sort(list_distinct(list(r) FILTER (WHERE t = 'Seq Scan'))), ','), '') AS seq_scans, true AS buffers
        FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'Index Scan' ELSE 'Sort' END AS t, 't' || (l_partkey % 5) AS r FROM lineitem) GROUP BY 1""",
    "bench_metrics": f"SELECT * FROM {_METRICS} m",
    "bench_gates": f"SELECT b.metric, v.value, b.bound, coalesce(CASE WHEN side = 'least' THEN v.value >= bound ELSE v.value <= bound END, false) AS passed FROM (VALUES ('precision', 'least', 0.4e0), ('recall', 'most', 0.4e0), ('absent', 'least', 0.1e0)) b(metric, side, bound) LEFT JOIN (SELECT metric, CASE WHEN metric = 'precision' THEN min(low) ELSE max(high) END AS value FROM {_METRICS} m GROUP BY 1) v ON v.metric = b.metric",
    "set_equality": "SELECT p_partkey, p_partkey % 3 <> 2 AS same, CAST(CASE WHEN p_partkey % 3 = 1 THEN len(list_distinct(string_split(p_type, ' '))) ELSE 0 END AS BIGINT) AS added FROM part",
    "price_prefix": """WITH p AS (SELECT p_brand AS prefix, max(CAST(p_size AS BIGINT)) AS price FROM part WHERE p_brand <> 'Brand#17' GROUP BY 1), s AS (SELECT substring(prefix, 1, 7) AS prefix, max(price) + 1000 AS price FROM p GROUP BY 1),
        t AS (SELECT * FROM p WHERE prefix NOT IN (SELECT prefix FROM s) UNION ALL SELECT * FROM s), m AS (SELECT p_partkey, p_brand || '-2024' AS model FROM part) SELECT p_partkey, (SELECT arg_max(price, length(prefix)) FROM t WHERE starts_with(model, prefix)) AS price FROM m""",
    "sql_equivalence": """WITH k AS (SELECT o_orderkey, o_orderkey % 16 AS k FROM orders), r AS (SELECT * FROM (VALUES
        (0, 'partially-verified', 'where+from', 'select', 'a|b|max(coalesce(c, (0)))', 1), (1, 'contradicted', 'projection', 'select', '*', 1), (2, 'partially-verified', 'row-limit', 'select', 'a|b|max(coalesce(c, (0)))', 1),
        (3, 'contradicted', 'distinct', 'select', 'a|b|max(coalesce(c, (0)))', 1), (4, 'partially-verified', 'where', 'select', 'a|b|max(coalesce(c, (0)))', 1), (5, 'contradicted', 'statement', 'delete', '', 0),
        (6, 'machine-verified', '', 'select', 'a|b|max(coalesce(c, (0)))', 1), (7, 'unverifiable', '', 'other', '', 0), (8, 'partially-verified', 'values', 'update', '', 0), (9, 'unverifiable', 'where', 'update', '', 0),
        (10, 'machine-verified', '', 'ddl-index', '', 0), (11, 'unverifiable', '', 'select', 'a|b|max(coalesce(c, (0)))', 1), (12, 'contradicted', 'projection', 'select', 'a|b|max(coalesce(c, (1)))', 1),
        (13, 'partially-verified', 'row-limit', 'select', 'a|b|max(coalesce(c, (0)))', 1), (14, 'contradicted', 'set-ops', 'select', 'a|b|max(coalesce(c, (0)))', 1), (15, 'machine-verified', '', 'select', 'a|b|max(coalesce(c, (0)))', 1)) r(k, status, deltas, kind, projection, joins))
        SELECT o_orderkey, status, deltas, kind, projection, CAST(joins AS BIGINT) AS joins FROM k JOIN r USING (k)""",
    "vocabulary_gap": "WITH n AS (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part), t AS (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part) SELECT word, count(*) AS n FROM n WHERE word NOT IN (SELECT word FROM t) GROUP BY 1",
}
