"""Pasted texts, findings and scopes: odd forms, nulls, empty tables, and keys that hold a third of all rows."""

from __future__ import annotations

import tarfile

import pytest
from pyspark.sql import functions as F

from brindle import session
from brindle.functions.hot import hot_keys, join_hot
from brindle.operators import captures, detect, ranking, recipes, report, review
from brindle.sources import files, sinks


def scope(path, text, line):
    s = detect.scopes(path, text, {line - 1})[line - 1]
    return len(s.headers), s.symbol, s.opens


@pytest.mark.parametrize(
    "path,text,line,expected",
    [
        ("a.py", "class A:\n  def b(self):\n    for x in y:\n\n      q()\n    r()\n", 5, (1, "A.b", False)),
        ("a.py", "class A:\n  def b(self):\n    for x in y:\n\n      q()\n    r()\n", 6, (0, "A.b", False)),
        ("a.py", "for x in y:\n  pass\n", 1, (0, None, True)),
        ("a.py", "z = [q(x) for x in y]\n", 1, (1, None, False)),
        ("a.py", "s = 'for x in y:'\n# for x in y:\n  q()\n", 3, (0, None, False)),
        ("a.rb", "def m\n  @a.each do |x|\n  q(x)\n  end\n  r\nend\n", 3, (1, "m", False)),
        ("a.rb", "def m\n  @a.each do |x|\n  q(x)\n  end\n  r\nend\n", 5, (0, "m", False)),
        ("a.ts", "function f() {\n  for (const x of y) {\n    q();\n  }\n  r();\n}\n", 3, (1, "f", False)),
        ("a.ts", "function f() {\n  for (const x of y) {\n    q();\n  }\n  r();\n}\n", 5, (0, "f", False)),
        ("A.java", "class A {\n  void m() {\n    for (X x : y)\n    {\n      q();\n    }\n  }\n}\n", 5, (1, "A.m", False)),
        ("a.ex", "defmodule M do\n  def f(x) do\n    Enum.each(x, fn y ->\n      q(y)\n", 4, (1, "M.f", False)),
    ],
)
def test_scopes(path, text, line, expected):
    assert scope(path, text, line) == expected


def test_loop_headers_above_the_excerpt_are_shown(spark):
    text = "for x in y:\n" + "  a = 1\n" * 20 + '  cursor.execute("SELECT a FROM t WHERE b")\n'
    row = detect.candidates(spark.createDataFrame([("a.py", text)], "path string, content string")).first()
    assert row["excerpt"].startswith("    1| for x in y:\n      … (lines above 16 omitted)\n  a = 1") and row["loop_depth"] == 1


def test_engines_by_profile(spark):
    df = spark.createDataFrame([("a.py", 'redis.keys("*")\n' + "x = 1\n" * 60 + 'cursor.execute("SELECT a FROM t WHERE b")\n'), ("db/mysql/x.sql", "SELECT a FROM t;")], "path string, content string")
    one = spark.createDataFrame([("postgres", True, False)], "engine string, primary boolean, ambiguous boolean")
    two = spark.createDataFrame([("postgres", True, True), ("mysql", False, True)], "engine string, primary boolean, ambiguous boolean")
    got = lambda p: {(r["path"], r["start_line"]): r["engine"] for r in detect.candidates(df, p).collect()}
    assert got(None)[("db/mysql/x.sql", 1)] == "mysql" and got(None)[("a.py", 62)] == "unknown"
    assert got(one)[("a.py", 62)] == "postgres" and got(two)[("a.py", 62)] == "unknown" and got(two)[("db/mysql/x.sql", 1)] == "mysql"


def test_plans_of_odd_forms(spark):
    rows = [
        (1, None), (2, ""), (3, "no plan"), (4, "[not json"), (5, '{"Plan": {"Node Type": "Result"}}'), (6, "Seq Scan on \"T\"  (cost=0.00..1.00 rows=1 width=4)\nSeq Scan on u  (cost=0.00..1.00 rows=9 width=4)"),
        (7, 'QUERY PLAN\n[{"Plan": {"Node Type": "Nested Loop", "Actual Loops": 2, "Actual Rows": 3, "Actual Total Time": 1.5, "Plans": [{"Node Type": "Index Scan", "Index Name": "i"}]}, "Execution Time": 4}]'),
    ]
    df = spark.createDataFrame(rows, "capture_id int, raw string")
    got = {r["capture_id"]: r for r in captures.plan_summary(df).collect()}
    assert sorted(got) == [5, 6, 7]
    assert (got[6]["nodes"], got[6]["seq_scans"], got[6]["timed"]) == (1, ["T"], False)
    assert (got[7]["nodes"], got[7]["root_ms"], got[7]["total_ms"], got[7]["timed"], got[7]["buffers"]) == (2, 3.0, 4.0, True, False)
    assert captures.plan_summary(df.limit(0)).count() == 0


def test_catalogs_and_logs_of_odd_forms(spark):
    rows = [(1, None), (2, ""), (3, "a | b"), (4, "Key_name | Column_name | Table\nx | c | t\nx | d | t\n | e | t"), (5, "relname|seq_scan\n(0 rows)"), (6, "attname,avg_width\na,4\n,5")]
    read = captures.catalogs(spark.createDataFrame(rows, "capture_id int, raw string"))
    assert {r["capture_id"]: r["form"] for r in read.collect() if r["form"]} == {4: "show-index", 6: "pg-stats"}
    assert [(r["name"], r["cols"]) for r in captures.observed_indexes(read).collect()] == [("x", ["c", "d"])]
    assert [(r["tab"], r["col"], r["width"]) for r in captures.observed_columns(read).collect()] == [("<unknown>", "a", 4.0)]
    assert captures.unknowable_left(read).count() == 6 * 4 - 1
    logs = [(1, None), (2, ""), (3, "[{"), (4, '[{"sql": "SELECT 1", "time": 0.5}, {"x": 1}]'), (5, '[{"x": 1}]\nSELECT 2'), (6, "[12:00] select 3 from t\nprisma:query SELECT 4")]
    got = {r["capture_id"]: (r["form"], r["statements"], r["total_ms"]) for r in captures.query_logs(spark.createDataFrame(logs, "capture_id int, raw string")).collect()}
    assert got[3][0] == "unreadable" and got[4] == ("django", ["SELECT 1"], 500.0) and got[6][:2] == ("prisma", ["SELECT 4"]) and got[1][0] is None and got[2][0] is None


def test_findings_without_what_they_cite(spark):
    schema = "id int, path string, line int, end_line int, excerpt string, original string, proposed string, kind string, category string, argument string, rationale string, migration string, evidence array<struct<file:string,quote:string,kind:string>>"
    rows = [(1, "a.py", 1, 1, "x = 1", "x = 1", "x = 2", "equivalent", "other", None, None, None, None), (2, None, 1, 1, "", "", "", "equivalent", "other", None, None, None, []), (3, "a.py", None, None, "", "", "", "behavioural", "n-plus-one", "", "", "", [(None, None, None)])]
    f = spark.createDataFrame([("a.py", "x = 1\n")], "path string, content string")
    got = {r["id"]: r for r in review.grounded(spark.createDataFrame(rows, schema), f).collect()}
    assert (got[1]["grounding"], got[2]["grounding"], got[3]["grounding"]) == ("verified", "rejected", "rejected")
    assert review.grounded(spark.createDataFrame([], schema), f).count() == 0


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("x.only('a').defer('b').count()", "x.count()", True), ("get((Q(a) | Q(b)))", "get(Q(a) | Q(b))", True), ("if ( x and f(y) ):", "if x and f(y)", True), ("return ((x))", "return x", True),
        ("x.values('a').count()", "x.count()", False), ("f(a, b)", "f(b, a)", False), ("f((a), (b))", "f(a, b)", False),
    ],
)
def test_inert_changes(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(review.without_inert(F.col("a")).alias("a"), review.without_inert(F.col("b")).alias("b")).first()
    assert (r["a"] == r["b"]) is same


def test_names_are_not_invented_in_a_small_corpus(spark):
    p = spark.createDataFrame([(1, "a.nowhere_to_be_found()"), (2, "FetchType.LAZY"), (3, "Gone.LAZY"), (4, None)], "id int, proposed string")
    few = spark.createDataFrame([("a", "x")], "path string, content string")
    many = spark.createDataFrame([(str(i), "FetchType objects " * 100) for i in range(30)], "path string, content string")
    assert review.invented_names(p, few).count() == 0
    assert {r["id"]: r["name"] for r in review.invented_names(p, many).collect()} == {1: "nowhere_to_be_found", 3: "LAZY"}


def test_answers_that_break_off(spark):
    rows = [(1, None), (2, ""), (3, "```json\n{\"findings\": []}\n```"), (4, '{"findings": [{"title": "a", "original": "b}", "path": "c"}, {"title": "d"'), (5, '{"findings": "no"}')]
    got = [(r["id"], r["title"], r["original"], r["repaired"]) for r in review.answers(spark.createDataFrame(rows, "id int, raw string")).collect()]
    assert got == [(4, "a", "b}", True)]


def test_differences_agree_with_a_common_subsequence():
    assert report.line_diff("", "") == [("ctx", 1, 1, "")]
    assert report.line_diff("a\nb\nc", "a\nc\nd\n\n") == [("ctx", 1, 1, "a"), ("del", 2, None, "b"), ("ctx", 3, 2, "c"), ("add", None, 3, "d")]
    assert report.line_diff("x", "y") == [("del", 1, None, "x"), ("add", None, 1, "y")]


def test_sources_say_why(spark, tmp_path):
    (tmp_path / "bad.tar.gz").write_bytes(b"\x1f\x8b broken")
    (tmp_path / "cut.tar").write_bytes(b"x" * 700)
    with tarfile.open(tmp_path / "empty.tar", "w"):
        pass
    got = files.from_archives(spark, str(tmp_path / "*.tar*")).collect()
    assert len(got) >= 1 and all(r["path"] is None and r["reason"] for r in got)
    folder = tmp_path / "f"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.py").write_text("x")
    (folder / "p.png").write_text("x")
    listed = files.listed(spark, str(folder), 3).collect()
    assert len(listed) == 3 and all(r["truncated"] for r in listed) and not files.listed(spark, str(folder), 9).first()["truncated"]
    assert [(r["path"].rsplit("/", 1)[-1], r["reason"]) for r in files.rejected(spark, str(folder)).collect()] == [("p.png", "not-scanned")]


def test_hot_keys_are_dealt_in_parts(spark):
    rows = spark.createDataFrame([(i % 3 and 7 or i, i) for i in range(3000)] + [(None, -1)], "k int, v int")
    table = spark.createDataFrame([(k, f"n{k}") for k in (7, 0, 3)], "k int, name string")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert [r["k"] for r in hot.collect()] == [7]
    left = join_hot(rows, table, ["k"], hot, ["v"], "left")
    assert left.count() == 3001 and left.filter("name = 'n7'").count() == 2000 and left.filter("name IS NULL").count() == 999
    assert join_hot(rows, table, ["k"], hot, ["v"]).count() == 2002 and join_hot(rows, table.select("k"), ["k"], hot, ["v"], "left_semi").count() == 2002
    assert join_hot(rows.limit(0), table, ["k"], hot_keys(rows.limit(0).groupBy("k").agg(F.count("*").alias("n")), ["k"]), ["v"]).count() == 0


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


def test_recipes_fall_back(spark):
    uses = spark.createDataFrame([("sqlite", "missing-index"), ("nonesuch", "redundant-index"), (None, "other"), ("redis", None)], "engine string, category string")
    got = {(r["engine"], r["category"]): (r["plan"], r["claim"], r["generic"]) for r in recipes.recipe_for(uses).collect()}
    assert got[("sqlite", "missing-index")] == ("EXPLAIN QUERY PLAN", None, True) and got[("nonesuch", "redundant-index")] == (None, "the engine's index usage", False)
    assert got[(None, "other")][0] == "EXPLAIN" and got[("redis", None)][2] is True


def test_summaries_of_nothing(spark):
    events = spark.createDataFrame([], "ts timestamp, kind string, site int, path string, done boolean, tokens long")
    assert tuple(ranking.store_summary(events, "ts", F.current_timestamp(), 60, "kind").first()) == (0, None, [])
    assert tuple(ranking.budget_left(events, F.col("done"), "site", "path").first()) == (0, 0, 0)
    assert tuple(ranking.estimate(events, "tokens", 3, 10, 1.0, 1.0).first()) == (0, 0, 0, 0.0)
    assert ranking.shown_with_rest(events, [F.col("site")], 3).count() == 0
    findings = spark.createDataFrame([], "path string, start_line int, severity string, title string, original string, proposed string, kind string, reason string")
    parts = sinks.document(findings, findings, spark.createDataFrame([(1, 1, 0)], "files int, read int, matched int")).collect()
    assert [tuple(p) for p in parts] == [(0, "", "1 of 1 files read, 0 sites matched")]
