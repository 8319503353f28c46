"""Steps whose rows grow with the input, not with its square: what joins make and exchanges write, read from the metrics of the plan that ran."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import captures, ddl, detect, matching
from brindle.plans import code_queries

N = 300


def nodes(plan):
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [plan.plan()] if "QueryStage" in name else []
    below = plan.children()
    for p in inner + [below.apply(i) for i in range(below.size())]:
        yield from nodes(p)
    yield plan


def most(df, kind: str, metric: str) -> int:
    """The largest figure of a metric among the nodes of a kind, after df is read."""
    df.collect()
    found = [p.metrics().get(metric).get().value() for p in nodes(df._jdf.queryExecution().executedPlan()) if kind in p.nodeName() and p.metrics().contains(metric)]
    assert found
    return max(found)


def test_pieces_without_a_key_are_not_shuffled(spark):
    texts = [(k, f"runs/clerk#{k:09d}/2-high/{k * 37}") for k in range(N)]
    keys = [(k, f"h/{k}" if k % 2 else f"#{k:09d}/") for k in range(40)]
    told = matching.contained(spark.createDataFrame(texts, "run int, path string"), spark.createDataFrame(keys, "ord int, key string"), "path", "key")
    assert most(told, "Exchange", "shuffleRecordsWritten") <= 4 * N
    assert sorted((r.run, r.ord) for r in told.collect()) == sorted((k, o) for k, p in texts for o, key in keys if key in p)


def test_proposals_meet_a_beginning_once(spark):
    proposed = spark.createDataFrame([(k, "T", ["a"] if k % 2 else ["a", "b"]) for k in range(N)], "id int, tab string, cols array<string>")
    declared = spark.createDataFrame([("t", ["a", "b"] if k % 3 else ["a", "b", "c"], k) for k in range(N)], "tab string, cols array<string>, ord long")
    told = ddl.index_advice(proposed, declared)
    assert most(told, "Join", "numOutputRows") <= 2 * N
    assert {tuple(r)[1:] for r in told.collect() if r.id % 2} == {(None, 0)} and {tuple(r)[1:] for r in told.collect() if r.id % 2 == 0} == {(1, 0)}


def test_observed_indexes_meet_a_beginning_once(spark):
    proposed = spark.createDataFrame([(k, "T", ["A"] if k % 2 else ["a", "b"]) for k in range(N)], "id int, tab string, cols array<string>")
    seen = spark.createDataFrame([("t", f"i{k}", ["a", "b"] if k % 3 else ["a", "b", "c"], k) for k in range(N)], "tab string, name string, cols array<string>, ord long")
    none = spark.createDataFrame([], "tab string, col string, distinct double, live_rows long")
    told = captures.against_observed(proposed, seen, none, none)
    assert most(told, "Join", "numOutputRows") <= 2 * N
    assert {(r.id % 2, r.existing, r.how) for r in told.collect()} == {(1, "i0", "covering"), (0, "i1", "exact")}


def test_covers_of_a_prefix_are_two_at_most(spark):
    rows = [(k, "t" if k % 5 else "T", ["a"] if k % 2 else ["a", "b"], k % 7 == 0) for k in range(N)]
    # An id of two rows is not its own cover.
    rows += [(N, "u", ["a"], False), (N, "u", ["a", "b"], False), (N + 1, "u", ["a", "b"], False), (N + 1, "u", ["a", "c"], False), (N + 2, "v", ["a"], False), (N + 2, "v", ["a", "b"], False)]
    want = {}
    for k, t, c, u in rows:
        for j, s, d, _ in rows:
            if not u and t.lower() == s.lower() and len(d) > len(c) and d[: len(c)] == c and j != k:
                want[k] = min(j, want.get(k, j))
    told = matching.prefix_covers(spark.createDataFrame(rows, "id int, tab string, cols array<string>, uniq boolean"), "tab", "cols", "id", "uniq")
    assert most(told, "Join", "numOutputRows") <= 2 * N
    assert {r.id: r.covered_by for r in told.collect()} == want and N + 2 not in want


def test_plans_are_read_in_one_pass(spark):
    rows = [(1, '[{"Plan": {"Node Type": "Seq Scan", "Relation Name": "a", "Shared Read Blocks": 3, "Plans": [{"Node Type": "Hash"}]}, "Execution Time": 2.5}]'), (2, 'Sort  (cost=0.00..9.00 rows=1 width=8) (actual time=0.1..2.5 rows=3 loops=2)\n  Sort Method: external merge\n  ->  Seq Scan on t  (cost=0.00..1.00 rows=1 width=8)\nPlanning Time: 0.5 ms'), (3, 'not a "Plan"'), (4, None)]
    told = captures.plan_summary(spark.createDataFrame(rows, "capture_id int, raw string"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
    got = {r.capture_id: (r.nodes, r.blocks_read, r.seq_scans, r.disk_sorts, r.buffers, r.timed, r.root_ms, r.total_ms, r.planning_ms) for r in told.collect()}
    assert got == {1: (2, 3, ["a"], [], True, False, None, 2.5, None), 2: (2, None, ["t"], ["external merge"], False, True, 5.0, None, 0.5)}


def test_both_tiers_scan_once(spark):
    files = spark.createDataFrame([("a.py", 'x = "SELECT a FROM t WHERE b"'), ("models/b.py", "class M(models.Model):\n    owner = models.ForeignKey(U)\n    n = M.objects.all")], "path string, content string")
    told = detect.both_tiers(files)
    assert "MapInArrow" not in told._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.detector.startswith("relevance")) for r in told.collect()} == {("a.py", False), ("models/b.py", True)}


def test_small_tables_make_files_in_many_parts(spark, sf_dir):
    for name in ("detect_pipeline", "scan_counters"):
        parts = code_queries.QUERIES[name](spark, sf_dir).select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1


def code_tables(spark, folder, orders: int) -> str:
    """Tables of four customers, one for each kind of file, with so many orders each."""
    spark.range(4).selectExpr("id AS c_custkey", "'B' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(4 * orders).selectExpr("id AS o_orderkey", "id % 4 AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_all_matches_of_a_rule_count_in_a_site(spark, tmp_path):
    told = {r.path: (r.start_line, r.end_line, r.matched) for r in code_queries.detect_pipeline(spark, code_tables(spark, tmp_path, 700)).collect()}
    assert told == {"app/views/v0.py": (5, 704, 1), "src/s1.ts": (5, 704, 1), "jobs/j2.rb": (4, 703, 1), "db/migrate/m3.sql": (1, 700, 1)}


def test_totals_count_all_matches_of_a_rule(spark):
    text = ("\n" + "b = 1\n" * 25).join(f'a = "SELECT x FROM t{i} WHERE y"' for i in range(700))
    assert tuple(detect.scan_totals(detect.scan(spark.createDataFrame([("a.py", text)], "path string, content string"))).first()) == (700, 0, 660, 1)


def test_tiers_hold_a_late_site_of_high_priority(spark):
    text = ("\n" + "b = 1\n" * 25).join(f'a = "SELECT x FROM t{i} WHERE y"' for i in range(700)) + "\n" + "b = 1\n" * 25 + 'for i in ids:\n    a = "SELECT x FROM t WHERE y"\n'
    told = detect.both_tiers(spark.createDataFrame([("a.py", text)], "path string, content string"))
    assert told.orderBy(told.priority.desc()).first().start_line == 26 * 700 + 2 and told.count() == 40


def test_counters_read_no_surroundings(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", ("\n" + "b = 1\n" * 25).join(f'a = "SELECT x FROM t{i} WHERE y"' for i in range(45))), ("b.py", "x = 1"), ("c.rb", "Order.where(id: 1)"), ("d.md", 'a = "SELECT x FROM t WHERE y"')], "path string, content string")
    scanned = detect.scan(files).select("path", "matched", "below_confidence", "low_priority", "found", F.size("sites").alias("kept"))
    assert sorted(map(tuple, detect.counted(files).collect())) == sorted(map(tuple, scanned.collect()))
    monkeypatch.setattr(detect, "scopes", None)
    assert detect.strengths("a.py", 'x = "SELECT a FROM t WHERE b"') == [{"best": 0.75, "n": 1}]


def test_rules_that_lack_a_needed_text_are_not_tried():
    assert detect.needs(r"(?:SELECT|INSERT)[\s\S]{0,9}?\$\d+|\bq\s+(?:a|bc)?x") == [[{"select", "insert"}, {"$"}], [{"q"}, {"x"}]]
    tried = lambda text: {detect.RULES[k].name for k, _, _ in detect._tried("py", detect._factors_in(text))}
    assert "postgres-placeholder" not in tried("SELECT a") and "postgres-placeholder" in tried("x\nSELECT a\n$1")
