"""Operators on small tables with known answers: ties, nulls, empty tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brindle.functions import paths, text
from brindle.functions.calls import call_deltas, query_dsl, with_call_shapes
from brindle.functions.running import global_rank, running_total
from brindle.functions.scoring import priority
from brindle.functions.statements import equivalence, split_top_level, strip_literals, top_level, with_sql_shapes
from brindle.functions.urls import repository
from brindle.operators import ddl, evidence, gate, matching, metrics, profile, ranking, spans
from brindle.sources import sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_running_total_and_rank_agree_with_a_loop(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 3), rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, v long").repartition(7)
    total, expected = 0, {}
    for place, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        total += v
        expected[i] = (total, place)
    got = running_total(df, [F.col("k"), F.col("id")], "v", "t").collect()
    assert {r["id"]: r["t"] for r in got} == {i: e[0] for i, e in expected.items()}
    got = global_rank(df, [F.col("k"), F.col("id")], "p").collect()
    assert {r["id"]: r["p"] for r in got} == {i: e[1] for i, e in expected.items()}


def test_running_total_of_nothing(spark):
    assert running_total(spark.createDataFrame([], "id int, v long"), [F.col("id")], "v", "t").count() == 0


def fold(hits, gap, wide):
    out = []
    for start, end, fragment in sorted(hits):
        if out and start <= out[-1][1] + (wide if fragment or out[-1][2] else gap):
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] or fragment)
        else:
            out.append((start, end, fragment))
    return out


def test_folded_spans_agree_with_a_loop(spark):
    rnd = random.Random(1)
    files = {f: [(s := rnd.randint(0, 4000), s + rnd.randint(1, 50), rnd.random() < 0.2) for _ in range(rnd.randint(1, 30))] for f in range(20)}
    files[99] = [(300, 310, False), (600, 610, True), (900, 910, False), (1200, 1210, False)]
    rows = [(f, s, k, e, g) for f, hits in files.items() for k, (s, e, g) in enumerate(hits)]
    df = spark.createDataFrame(rows, "file int, start int, ord int, end int, fragment boolean")
    got = spans.folded_spans(df.repartition(5), "file").collect()
    for f in files:
        hits = [(s, e, g) for g_, s, k, e, g in sorted(rows, key=lambda x: (x[1], x[2])) if g_ == f]
        assert sorted((r["first"], r["last"], r["fragment"]) for r in got if r["file"] == f) == sorted(fold(hits, 120, 400))
    assert sum(r["hits"] for r in got) == len(rows)
    assert [(r["first"], r["last"]) for r in got if r["file"] == 99] == [(300, 1210)]
    assert spans.folded_spans(df.limit(0), "file").count() == 0


@pytest.mark.parametrize(
    "path,symbol,handler,expected",
    [
        ("db/migrate/1_x.rb", None, False, "migration"),
        ("services/migrations/github.go", None, False, "unknown"),
        ("modelmigration/v1_13/v143.go", None, False, "migration"),
        ("x/test_a/b.spec.ts", None, False, "test"),
        ("src/a.py", "GroupsController.show", False, "request-handler"),
        ("src/a.py", None, True, "request-handler"),
        ("app/views.py", None, False, "request-handler"),
        ("app/jobs/x.py", None, False, "job"),
        ("src/a.py", "MailWorker.run", False, "job"),
        ("src/a.py", None, False, "unknown"),
    ],
)
def test_trigger_takes_the_first_rule(spark, path, symbol, handler, expected):
    assert value(spark, paths.trigger(F.lit(path), F.lit(symbol).cast("string"), F.lit(handler))) == expected


@pytest.mark.parametrize("path,prose", [("a/README.md", True), ("mvnw", True), ("gradlew.bat", True), ("run.sh", False), ("config/locales/en.yml", True), ("Rakefile", False), ("bin/service", True), ("a/b.py", False), ("x.scss", True)])
def test_prose(spark, path, prose):
    assert value(spark, paths.is_prose(F.lit(path))) is prose


def test_scannable(spark):
    for path, size, ok in [("a/node_modules/b.js", 1, False), ("a.py", 512 * 1024, True), ("a.py", 512 * 1024 + 1, False), ("x/yarn.lock", 1, False), ("i.png", 1, False)]:
        assert value(spark, paths.is_scannable(F.lit(path), F.lit(size))) is ok


def test_priority_is_clamped_and_says_why(spark):
    score, reasons = priority(F.lit("tests/a.py"), F.lit("x"), F.lit(0), F.lit("test"), F.lit("ddl-migration"))
    r = spark.range(1).select(score.alias("s"), reasons.alias("r")).first()
    assert r["s"] == 0.0 and r["r"] == ["-0.45 test path", "-0.30 schema definition"]


def test_text_helpers(spark):
    t = F.lit("one\ntwo\nthree")
    assert value(spark, text.line_of(t, F.lit(5))) == 2
    assert value(spark, text.slice_lines(t, F.lit(-3), F.lit(2))) == "one\ntwo"
    assert value(spark, text.slice_lines(t, F.lit(7), F.lit(9))) == ""
    assert value(spark, text.contains_loosely(F.lit('a "B"  c'), F.lit("b C"))) is True
    assert value(spark, text.contains_loosely(F.lit("abc"), F.lit(""))) is True
    assert value(spark, text.mask_key(F.lit("abcd1234efgh"))) == "abcd****efgh"
    assert value(spark, text.first_significant_line(F.lit("1 | x\n 12 | select everything"))) == "select everything"


@pytest.mark.parametrize(
    "a,b,status",
    [
        ("SELECT a FROM t", "select  a\nfrom t -- x", "machine-verified"),
        ("SELECT a, f(b, c) FROM t", "SELECT a FROM t", "contradicted"),
        ("SELECT a FROM t", "SELECT DISTINCT a FROM t", "contradicted"),
        ("SELECT a FROM t", "SELECT a FROM t LIMIT 3", "partially-verified"),
        ("SELECT a FROM t WHERE x = 'b'", "SELECT a FROM t WHERE y = 1", "partially-verified"),
        ("SELECT a FROM t ORDER BY a ASC", "SELECT a FROM t ORDER BY a", "machine-verified"),
        ("SELECT a FROM t", "DELETE FROM t", "contradicted"),
        ("CREATE INDEX i ON t (a)", "CREATE INDEX i ON t (a, b)", "machine-verified"),
        ("hello", "there", "unverifiable"),
        ("SELECT a FROM t UNION SELECT b FROM u", "SELECT a FROM t", "contradicted"),
    ],
)
def test_equivalence(spark, a, b, status):
    rows = with_sql_shapes(spark.createDataFrame([(a, b)], "a string, b string"), x=F.col("a"), y=F.col("b"))
    assert rows.select(equivalence(F.col("x"), F.col("y")).alias("e")).first()["e"]["status"] == status


def test_brackets_and_literals_at_any_depth(spark):
    deep = "f(" * 40 + "a, b" + ")" * 40
    assert value(spark, split_top_level(top_level(F.lit(f"x, {deep} , 'a,(b'"))) ) == ["x", deep, "'§'"]
    assert value(spark, strip_literals(F.lit("a -- 'x'\n'it''s -- \\' no' \"q -- r\" /* ' */ `w`"))) == "a \n'§' \"q -- r\"   \"w\""
    shape = with_sql_shapes(spark.createDataFrame([("SELECT a, (SELECT b FROM c WHERE d LIMIT 2) AS e FROM t x WHERE f IN (SELECT 1 FROM g) LIMIT 3",)], "s string"), x=F.col("s")).first()["x"]
    assert (shape["projection"], shape["source"], shape["where"], shape["limit"]) == (["a", "(select b from c where d limit 2) as e"], "t x", "f IN (SELECT 1 FROM g)", "3")


@pytest.mark.parametrize(
    "a,b,status,hard,soft,undecided",
    [
        ("for o in q:\n  A.objects.filter(id=o).count()", "A.objects.filter(id__in=q)", "partially-verified", [], ["terminal"], ["consumption"]),
        ("A.objects.values('a').filter(b=1)", "A.objects.values('b').filter(b=1)", "contradicted", ["projection"], [], []),
        ("A.objects.filter(b=1).first()", "A.objects.filter(b=1).count()", "contradicted", ["terminal"], ["row-limit"], []),
        ("A.objects.filter(b=1).order_by('x').all()", "A.objects.filter(b=1).all()", "partially-verified", [], ["order-by"], []),
        ("A.objects.filter(b=1).all()", "A.objects.filter(c=1).distinct().all()", "contradicted", ["distinct"], [], ["predicates"]),
        ("A.objects.filter(b=1).all()", "A.objects.filter(b=1).all()", "machine-verified", [], [], []),
        ("A.objects.filter(b=1).all()", "A.objects.filter(b=1).update(c=2)", "contradicted", ["writes"], [], []),
    ],
)
def test_equivalence_of_calls(spark, a, b, status, hard, soft, undecided):
    rows = with_call_shapes(spark.createDataFrame([(a, b)], "a string, b string"), F.lit(0), x=F.col("a"), y=F.col("b"))
    e = rows.select(call_deltas(F.col("x"), F.col("y")).alias("e")).first()["e"]
    assert (e["status"], e["hard"], e["soft"], e["undecided"]) == (status, hard, soft, undecided)


def test_long_literals_do_not_overflow(spark):
    from brindle.functions.shapes import normalise_shape

    assert value(spark, normalise_shape(F.lit("SELECT '" + "x''" * 60_000 + "'"))) == "SELECT ?"


def test_repository(spark):
    r = value(spark, repository(F.lit("https://gitlab.com/a/b/c/-/merge_requests/7")))
    assert (r["forge"], r["owner"], r["name"], r["pull_request"]) == ("gitlab", "a/b", "c", 7)
    assert value(spark, repository(F.lit("git@github.com:o/n.git")))["name"] == "n"
    assert value(spark, repository(F.lit("nothing")))["owner"] is None


def test_calls(spark):
    texts = ["for x in y:\n  A.objects.get(id=x).b.count()", "A.objects.filter(id__in=y).count()", "x = 1", None]
    rows = with_call_shapes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), F.lit(1), s=F.col("t")).orderBy("i").collect()
    assert (rows[0]["s"]["dialect"], rows[0]["s"]["trips"], rows[0]["s"]["per_iteration"]) == ("django", 2, True)
    assert (rows[1]["s"]["batched"], rows[1]["s"]["per_iteration"]) == (True, False)
    assert rows[2]["s"] is None and rows[3]["s"] is None
    assert value(spark, query_dsl(F.lit("redis.hgetall('a')"))) == "kv-command"
    assert value(spark, query_dsl(F.lit("d.get('a')"))) is None


def test_ddl(spark):
    files = spark.createDataFrame(
        [
            ("a.sql", "CREATE TABLE T (id int, a text, PRIMARY KEY (id));\nCREATE UNIQUE INDEX i ON t (a, id DESC);"),
            ("s.prisma", "model U {\n id Int\n @@index([a, b])\n}"),
            ("m.rb", "add_index :users, [:a, :b], unique: true"),
            ("v.py", "op.create_index('ix', 'users', ['a'])"),
        ],
        "path string, content string",
    )
    got = {(r["source"], r["tab"], tuple(r["cols"]), r["uniq"]) for r in ddl.index_facts(files).collect()}
    assert got == {("key", "T", ("id",), True), ("sql", "t", ("a", "id"), True), ("prisma", "U", ("a", "b"), False), ("rails", "users", ("a", "b"), True), ("alembic", "users", ("a",), False)}
    assert sorted((r["tab"], r["cols"]) for r in ddl.table_facts(files).collect()) == [("t", ["id", "a"]), ("u", ["id"])]


def test_tolerance_join_meets_every_pair_once(spark):
    rnd = random.Random(2)
    a = [(rnd.randint(0, 2), rnd.randint(-40, 40), i) for i in range(120)]
    b = [(rnd.randint(0, 2), rnd.randint(-40, 40), i) for i in range(120)]
    got = matching.tolerance_join(spark.createDataFrame(a, "f int, x long, i int"), spark.createDataFrame(b, "f int, y long, j int"), ["f"], "x", "y", 3)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for f, x, i in a for g, y, j in b if f == g and abs(x - y) <= 3)


def test_prefix_covers(spark):
    rows = [(1, "T", ["a"], False), (2, "t", ["a", "b"], False), (3, "t", ["b"], True), (4, "t", ["b", "c"], False), (5, "t", ["a"], False)]
    got = matching.prefix_covers(spark.createDataFrame(rows, "id int, tab string, cols array<string>, uniq boolean"), "tab", "cols", "id", "uniq")
    assert {(r["id"], r["covered_by"]) for r in got.collect()} == {(1, 2), (5, 2)}


def test_evidence(spark):
    change = lambda a, b: value(spark, evidence.relative_change(F.lit(a).cast("long"), F.lit(b).cast("long")))
    assert change(0, 0) == 0.0 and change(0, 50) is None and change(3, 9) is None and change(None, 4) is None and change(100, 50) == -0.5
    at = lambda s: F.lit(s).cast("timestamp")
    state = lambda t, c: value(spark, evidence.staleness(at(t), F.lit(c), at("2024-01-20 00:00:00"), F.lit("h")))
    assert [state(None, "h"), state("2024-01-20 00:02:00", "x"), state("2024-01-19 00:00:00", "x"), state("2024-01-01 00:00:00", "h"), state("2024-01-19 00:00:00", "h")] == ["unreadable", "future", "other-commit", "old", "fresh"]


def test_retention_packing_and_floor(spark):
    df = spark.createDataFrame([(i, i % 2, float(i) / 10, 1000) for i in range(10)], "id int, k int, s double, tokens long")
    assert sorted(r["id"] for r in ranking.keep_at_least(df, "s", 0.8, 4, [F.col("s").desc()]).collect()) == [6, 7, 8, 9]
    assert sorted(r["id"] for r in ranking.keep_at_least(df, "s", 0.3, 4, [F.col("s").desc()]).collect()) == [3, 4, 5, 6, 7, 8, 9]
    packed = {r["id"]: r["chunk"] for r in ranking.pack_chunks(df, "k", "id", "tokens", 2200, 12).collect()}
    assert packed == {0: 0, 2: 0, 4: 1, 6: 1, 8: 2, 1: 0, 3: 0, 5: 1, 7: 1, 9: 2}


def test_profile_and_support(spark):
    d = spark.createDataFrame([("redis", 100, 1), ("mysql", 90, 2), ("postgres", 90, 3), ("mysql", 60, 0)], "e string, a int, o int")
    got = {r["engine"]: (r["authority"], r["primary"], r["ambiguous"]) for r in profile.engine_profile(d, "e", "a", "o").collect()}
    # Only a cache has the highest authority: it is the primary engine, and what stands below it is no rival.
    assert got == {"redis": (100, True, False), "mysql": (90, False, False), "postgres": (90, False, False)}
    one = spark.createDataFrame([("mysql", 90, 2), ("mariadb", 90, 3)], "e string, a int, o int")
    assert {r["ambiguous"] for r in profile.engine_profile(one, "e", "a", "o").collect()} == {False}
    v = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, False), (2, 2, False)], "site int, sample int, f boolean")
    assert {r["site"]: (r["flagged"], r["samples"], r["verdict"]) for r in profile.triage_support(v, "site", "sample", F.col("f")).collect()} == {1: (1, 3, "problem"), 2: (0, 3, "clean")}


def test_declarations(spark):
    files = [("app/settings.py", "X = 1\n  ENGINE = 'django.db.backends.postgresql'\n"), ("requirements.txt", "redis>=4\n# pymongo\nno-psycopg2\n"), ("docker-compose.yml", "image: mysql:8"), ("src/a.py", "jdbc:mysql:"), ("package.json", '{"pg": "8"}')]
    got = {(r["path"], r["engine"], r["authority"], r["quote"]) for r in profile.declarations(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("app/settings.py", "postgres", 100, "ENGINE = 'django.db.backends.postgresql'"), ("requirements.txt", "redis", 70, "redis>=4"), ("docker-compose.yml", "mysql", 60, "image: mysql:8"), ("package.json", "postgres", 70, '{"pg": "8"}')}


def test_metrics_ignore_what_is_not_there(spark):
    runs = spark.createDataFrame([Row(c="a", p=0.5, r=None), Row(c="a", p=1.0, r=None)], "c string, p double, r double")
    got = {r["metric"]: (r["mean"], r["low"], r["high"], r["n"]) for r in metrics.summary(runs, ["c"], ["p", "r"]).collect()}
    assert got == {"p": (0.75, 0.5, 1.0, 2), "r": (None, None, None, 0)}


def test_severity_is_capped_last(spark):
    assert value(spark, gate.capped(F.lit("high"), F.lit(False), F.lit(3), F.lit(1), F.lit(0))) == "medium"
    assert value(spark, gate.capped(F.lit("high"), F.lit(True), F.lit(3), F.lit(3), F.lit(0))) == "low"
    assert value(spark, gate.capped(F.lit("high"), F.lit(False), F.lit(2), F.lit(0), F.lit(0))) == "high"


def test_keys_inside_texts(spark):
    texts = ["runs/alpha-17/x", "runs/alpha-1/7", "alpha", "", None, "zzz" * 50, "日本/é-1"]
    keys = ["alpha-1", "a-1/7", "alpha-17/x and more", "", None, "z", "zzzzzz", "本/é", "alpha-1", "runs/alpha-1"]
    t = spark.createDataFrame(list(enumerate(texts)), "run int, path string")
    k = spark.createDataFrame(list(enumerate(keys)), "ord int, key string")
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(keys) if x and y and y in x)
    for gram in (1, 3, 6, 40):
        assert sorted((r["run"], r["ord"]) for r in matching.contained(t, k, "path", "key", gram).collect()) == want
    told = {r["run"]: r["adjudicated"] for r in matching.adjudicated(t, k.withColumn("adjudicated", F.concat(F.lit("v"), F.col("ord")))).collect()}
    assert told == {0: "v0", 1: "v0", 2: None, 3: None, 4: None, 5: "v5", 6: "v7"}
    assert matching.contained(t, k.limit(0), "path", "key").count() == 0 and matching.contained(t.limit(0), k, "path", "key").count() == 0


def test_one_catalog_of_declared_and_observed(spark):
    index = "tab string, name string, cols array<string>, uniq boolean"
    declared = [(1, "t", "ix_a", ["a"], True), (2, "T", "ix_b", ["b", "a"], False), (3, "t", "other", ["A"], False), (4, "u", "ix_a", ["a"], False), (5, None, "ix_a", ["a"], False), (6, "t", "nothing", [], False)]
    observed = [('"T"', "IX_A", ["a"], True, 7, 100, 0), ("t", "live", ["b", "a"], False, None, None, 1), ("t", "usage", [], False, 3, None, 2), ("t", "IX_A", ["z"], False, None, None, 3), ("t", "live", ["q"], False, None, None, 4)]
    rows = matching.grounded_catalog(
        spark.createDataFrame(declared, "id int, " + index), spark.createDataFrame(observed, index + ", scans long, size_bytes long, ord int"), spark.createDataFrame([("t", 50), ("T", 40), ("v", None)], "tab string, live_rows long"),
        spark.createDataFrame([("t", "A", -1.0, 0.5, None)], "tab string, col string, distinct double, null_fraction double, width double"),
    ).collect()
    got = sorted((r["tab"], r["name"], r["cols"], r["origin"], r["scans"], r["observed"], r["live_rows"], r["distinct"]) for r in rows if r["tab"])
    assert got == sorted([
        ("t", "IX_A", ["a"], "both", 7, True, 50, -1.0), ("T", "live", ["b", "a"], "both", None, True, 50, None), ("t", "IX_A", ["a"], "both", 7, True, 50, -1.0), ("u", "ix_a", ["a"], "declared", None, False, None, None),
        ("t", "nothing", [], "declared", None, True, 50, None), ("t", "usage", [], "observed", 3, True, 50, None),
    ])
    assert [(r["name"], r["origin"], r["observed"]) for r in rows if r["tab"] is None] == [("ix_a", "declared", False)]


def test_primary_engine_among_caches(spark):
    frame = lambda rows: spark.createDataFrame([(e, a, k) for k, (e, a) in enumerate(rows)], "e string, a int, o int")
    told = lambda rows: {r["engine"]: (r["primary"], r["ambiguous"]) for r in profile.engine_profile(frame(rows), "e", "a", "o").collect()}
    assert told([("solr", 90), ("postgres", 90)]) == {"solr": (False, False), "postgres": (True, False)}
    assert told([("redis", 100), ("postgres", 90)]) == {"redis": (True, False), "postgres": (False, False)}
    assert told([("redis", 100), ("etcd", 100)]) == {"redis": (True, False), "etcd": (False, False)}
    assert told([("mysql", 90), ("postgres", 90), ("pgvector", 90)])["mysql"] == (True, True)


def test_which_paths_are_scanned(spark):
    rows = [("src/a.py", 5), ("node_modules/x.js", 5), ("a/Pods/x.m", 5), ("x.PNG", 5), ("yarn.lock", 5), ("a/GO.SUM", 5), ("big.py", 10**9), ("noext", 1), ("build/x.py", 1), ("rebuild/x.py", 1), ("a.b.lock", 1), ("", 0)]
    got = spark.createDataFrame(rows, "p string, s long").select("p", "s", paths.is_scannable(F.col("p"), F.col("s")).alias("y")).collect()
    assert [r["y"] for r in got] == [paths.scannable(p, s) for p, s in rows]


def test_what_is_asked_again(spark):
    sent = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 1), (None, 1)], "site string, attempt int")
    answered = spark.createDataFrame([("c",), (None,), ("x",)], "site string")
    assert [tuple(r) for r in matching.next_requests(sent, answered, "site", "attempt").collect()] == [("a", 2)]
    assert sorted(tuple(r) for r in matching.next_requests(sent, answered.limit(0), "site", "attempt", 3).collect()) == [("a", 2), ("b", 3), ("c", 2)]


def test_findings_truths_and_candidates(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "f string, at int")
    told = matching.found_both_ways(side(("a", 10), ("a", 11), ("b", 5), (None, 1)), side(("a", 12), ("b", 9), ("c", 1), (None, 1)), side(("a", 12), ("b", 8), ("a", 12)), ["f"], "at", 2)
    assert {k: sorted((r["f"], r["at"]) for r in v.collect()) for k, v in told.items()} == {"real": [("a", 10), ("a", 11)], "found": [("a", 12)], "covered": [("a", 12), ("b", 9)]}


def test_scorecards_are_dated(spark, tmp_path):
    lines = spark.createDataFrame([("x", "precision 50%")], "k string, line string")
    assert len(sinks.scorecards(lines, str(tmp_path), "2026-01-01", True)) == 2
    sinks.scorecards(lines.withColumn("line", F.lit("precision 0%")), str(tmp_path), "2026-01-02", False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2026-01-01", "2026-01-02", "latest"] and spark.read.json(str(tmp_path / "latest")).first()["line"] == "precision 50%"
