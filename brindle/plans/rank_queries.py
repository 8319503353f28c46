"""Queries that rank, cut, merge and pack: rows of orders, lineitem, events and documents seen as sites, hits and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.scoring import MIN_CONFIDENCE, confidence, priority
from brindle.operators import ranking, spans
from brindle.tables import table

#: Fixed moments and amounts of the queries.
NOW = "2024-01-30 12:00:00"
GAP, FRAGMENT_GAP = 12_000, 40_000


def _epoch(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query site for each order."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "app/migrations/").when(F.col("o_orderkey") % 9 == 1, "tests/").otherwise("src/"), F.col("o_custkey").cast("string"), F.lit(".py"))
    excerpt = F.when(F.col("o_orderkey") % 4 == 0, "rows = X.objects.all()").when(F.col("o_orderkey") % 4 == 1, "n = q.count()").when(F.col("o_orderkey") % 4 == 2, "SELECT * FROM t LIMIT 5").otherwise("q.select_related('a')")
    trigger = F.when(F.col("o_orderstatus") == "F", "request-handler").when(F.col("o_orderstatus") == "P", "migration").otherwise("unknown")
    style = F.when(F.col("o_orderkey") % 10 == 0, "ddl-migration").otherwise("orm")
    score, reasons = priority(path, excerpt, (F.col("o_custkey") % 3).cast("int"), trigger, style)
    return o.select("o_orderkey", "o_custkey", "o_totalprice", score.alias("priority"), F.size(reasons).cast("long").alias("reasons"))


_SITES = """(SELECT o_orderkey, o_custkey, o_totalprice, greatest(0, least(1, round(0.4e0 + 0.35e0 * a + 0.15e0 * b - 0.4e0 * c - 0.45e0 * d - 0.4e0 * e + 0.1e0 * f + 0.1e0 * g - 0.15e0 * h - 0.3e0 * i, 4))) AS priority, CAST(a + b + c + d + e + f + g + h + i AS BIGINT) AS reasons FROM (
  SELECT *, CASE WHEN o_custkey % 3 > 0 THEN 1 ELSE 0 END AS a, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS b, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN o_orderkey % 9 = 1 THEN 1 ELSE 0 END AS d,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 9 <> 0 THEN 1 ELSE 0 END AS e, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS f, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS g,
    CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS h, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS i FROM orders))"""


def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("o_orderkey", F.round("priority", 4).alias("priority"), "reasons")


def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans: the best discount is the best rule, lines are hits."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("best"), F.count("*").alias("hits"))
    return li.select("l_orderkey", F.round(confidence(F.lit(0.6) + F.col("best"), F.col("hits")), 4).alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)


def topk_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return ranking.top_k(li, ["l_orderkey"], [F.col("l_discount").desc(), F.col("l_quantity").desc(), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "l_discount")


def min_priority_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_at_least(sites(spark, sf_dir), "priority", 0.95, 40, [F.col("priority").desc(), F.col("o_orderkey")]).select("o_orderkey", F.round("priority", 4).alias("priority"))


def global_rank_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred sites that are written up: the feature is the limit."""
    return sites(spark, sf_dir).orderBy(F.col("priority").desc(), F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", F.round("priority", 4).alias("priority"))


def span_merge_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", _epoch("ts").alias("first"), (_epoch("ts") + F.length("event_type")).alias("last"))
    return spans.merge_fixed(e.withColumnsRenamed({"first": "start", "last": "end"}), ["user_id"], "start", "end", GAP)


def span_merge_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits of a user's file; errors are fragments, with the wider gap."""
    hits = table(spark, sf_dir, "events").select("user_id", _epoch("ts").alias("start"), F.col("event_id").alias("ord"), (_epoch("ts") + F.length("event_type")).alias("end"), (F.col("event_type") == "error").alias("fragment"))
    return spans.folded_spans(hits, "user_id", GAP, FRAGMENT_GAP)


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 10")
    return spans.line_runs(li, ["l_orderkey"], "l_linenumber")


def context_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return spans.in_frame(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2, 4).select("event_id", "user_id")


def fixed_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites(spark, sf_dir)
    return ranking.fixed_passes(s, [F.col("priority").desc(), F.col("o_orderkey")], 60).select("o_orderkey", "pass_no")


def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in order, as long as what was spent before is within half of all."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    half = li.agg(F.floor(F.sum("cents") / 2)).first()[0] or 0
    return ranking.within_budget(li, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("cents")], "cents", half).select("l_orderkey", "l_linenumber", "spent_before")


def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 3.6).cast("long").alias("tokens"))
    return ranking.pack_chunks(d, "source", "doc_id", "tokens", 8_000, 12)


def cache_ttl_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ranking.newest(e, "at", F.lit(NOW).cast("timestamp"), 10 * 86400, ["user_id"], 6, "event_id").select("user_id", "event_id")


def session_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("started"), "events")


QUERIES = {
    "priority_score": priority_score, "confidence_floor": confidence_floor, "topk_per_file": topk_per_file, "min_priority_keep": min_priority_keep, "global_rank_limit": global_rank_limit, "span_merge_fixed": span_merge_fixed,
    "span_merge_stateful": span_merge_stateful, "line_runs": line_runs, "context_frame": context_frame, "fixed_passes": fixed_passes, "running_budget": running_budget, "pack_chunks": pack_chunks, "cache_ttl_newest": cache_ttl_newest, "session_idle": session_idle,
}
_EVENTS = "(SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
ORACLE_SQL = {
    "priority_score": f"SELECT o_orderkey, round(priority, 4) AS priority, reasons FROM {_SITES} s",
    "confidence_floor": f"SELECT * FROM (SELECT l_orderkey, round(least(0.99e0, 0.6e0 + max(l_discount) + 0.05e0 * (count(*) - 1)), 4) AS confidence FROM lineitem GROUP BY 1) WHERE confidence >= {MIN_CONFIDENCE}e0",
    "topk_per_file": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_quantity DESC, l_linenumber) <= 3",
    "min_priority_keep": f"WITH s AS (SELECT *, row_number() OVER (ORDER BY priority DESC, o_orderkey) AS n, count(*) FILTER (WHERE priority >= 0.95e0) OVER () AS above FROM {_SITES} x) SELECT o_orderkey, round(priority, 4) AS priority FROM s WHERE n <= greatest(40, above)",
    "global_rank_limit": f"SELECT o_orderkey, round(priority, 4) AS priority FROM {_SITES} s ORDER BY s.priority DESC, o_totalprice DESC, o_orderkey LIMIT 100",
    "span_merge_fixed": f"""WITH e AS (SELECT user_id, t AS s, t + length(event_type) AS f FROM {_EVENTS} x), r AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
        n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS k FROM r)
        SELECT user_id, min(s) AS first, max(f) AS last, count(*) AS hits FROM n GROUP BY user_id, k""",
    "span_merge_stateful": f"""WITH RECURSIVE e AS (SELECT user_id, t AS s, t + length(event_type) AS f, event_type = 'error' AS g, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM {_EVENTS} x),
        w AS (SELECT user_id, n, s AS first, f AS last, g AS fragment, 1 AS hits, 1 AS span FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.n, CASE WHEN j THEN w.first ELSE e.s END, CASE WHEN j THEN greatest(w.last, e.f) ELSE e.f END, CASE WHEN j THEN w.fragment OR e.g ELSE e.g END, CASE WHEN j THEN w.hits + 1 ELSE 1 END, CASE WHEN j THEN w.span ELSE w.span + 1 END
          FROM w JOIN (SELECT e.*, w2.last + CASE WHEN e.g OR w2.fragment THEN {FRAGMENT_GAP} ELSE {GAP} END >= e.s AS j FROM e JOIN w w2 ON e.user_id = w2.user_id AND e.n = w2.n + 1) e ON e.user_id = w.user_id AND e.n = w.n + 1)
        SELECT user_id, first, last, CAST(hits AS BIGINT) AS hits, fragment FROM w QUALIFY row_number() OVER (PARTITION BY user_id, span ORDER BY n DESC) = 1""",
    "line_runs": """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM d)
        SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, count(*) AS lines FROM r GROUP BY l_orderkey, k""",
    "context_frame": "SELECT event_id, user_id FROM events QUALIFY max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING) = 1",
    "fixed_passes": f"SELECT o_orderkey, (row_number() OVER (ORDER BY priority DESC, o_orderkey) - 1) // 60 AS pass_no FROM {_SITES} s",
    "running_budget": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem), r AS (SELECT *, CAST(coalesce(sum(cents) OVER (ORDER BY l_orderkey, l_linenumber, cents ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM l)
        SELECT l_orderkey, l_linenumber, spent_before FROM r WHERE spent_before < (SELECT sum(cents) // 2 FROM l)""",
    "pack_chunks": """WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(n_chars / 3.6e0) AS BIGINT) + 60 AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
        w AS (SELECT source, doc_id, n, CAST(0 AS BIGINT) AS chunk, c AS used, 1 AS k FROM d WHERE n = 1
          UNION ALL SELECT d.source, d.doc_id, d.n, CASE WHEN w.k >= 12 OR w.used + d.c > 8000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.k >= 12 OR w.used + d.c > 8000 THEN d.c ELSE w.used + d.c END, CASE WHEN w.k >= 12 OR w.used + d.c > 8000 THEN 1 ELSE w.k + 1 END
          FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
        SELECT source, doc_id, chunk FROM w""",
    "cache_ttl_newest": f"SELECT user_id, event_id FROM events WHERE ts <= TIMESTAMP '{NOW}' AND floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts)) < 864000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 6",
    "session_idle": """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS events FROM s GROUP BY user_id, k""",
}
