"""Entries without a model, functions by name, fingerprints, progress and cancellation."""

from __future__ import annotations

import hashlib
import random
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.operators import captures, detect, fingerprint, progress, registered, tools
from tests.test_code import PY

FILES = [("app/a.py", PY), ("app/b.py", PY.replace("OrdersView", "Job")), ("db/schema.sql", "CREATE TABLE t (id int, a int);\nCREATE INDEX i1 ON t (a);\nCREATE INDEX i2 ON t (a, id);\n"), ("docker-compose.yml", "services:\n  db:\n    image: postgres:16\n"), ("none.py", None)]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_detect_queries(files):
    sites, summary = tools.detect_queries(files)
    (s,) = summary.collect()
    rows = sites.collect()
    assert (s["files"], s["candidates"], s["more"], s["primary"], s["ambiguous"]) == (5, len(rows), 0, "postgres", False) and len(rows) >= 2
    assert [d["engine"] for d in s["declared"]] == ["postgres"] and "postgres:16" in s["declared"][0]["quote"]
    assert [r["priority"] for r in rows] == sorted((r["priority"] for r in rows), reverse=True) and all(len(r["excerpt"]) <= 300 for r in rows)
    few, summary = tools.detect_queries(files, shown=1)
    assert few.count() == 1 and summary.first()["more"] == len(rows) - 1
    none, summary = tools.detect_queries(files.limit(0))
    assert none.count() == 0 and tuple(summary.first())[:3] == (0, 0, 0)


def test_check_equivalence(spark):
    pairs = spark.createDataFrame([(1, "SELECT a FROM t", "SELECT b FROM t"), (2, "Order.objects.filter(a=1).count()", "Order.objects.filter(a=1).count()"), (3, None, "x"), (4, "a = 1", "b = 2")], "id int, original string, proposed string")
    by = {k: {r["id"]: (r["reader"], r["status"]) for r in tools.check_equivalence(pairs, k).collect()} for k in ("auto", "sql", "orm")}
    assert by["auto"] == {1: ("sql", "contradicted"), 2: ("orm", "machine-verified"), 3: ("sql", "unverifiable"), 4: ("sql", "unverifiable")}
    assert by["sql"][2] == ("sql", "unverifiable") and by["orm"][1] == ("orm", "unverifiable") and by["orm"][2] == ("orm", "machine-verified")


def test_schema_facts_and_recipes(spark, files):
    told = tools.schema_facts(files, spark.createDataFrame([(1, "CREATE INDEX n ON t (a)"), (2, "CREATE INDEX n ON t (zz)")], "id int, text string"))
    assert [(r["tab"], r["cols"]) for r in told["tables"].collect()] == [("t", ["id", "a"])]
    assert told["indexes"].count() == 2 and told["redundant"].count() == 1
    advice = {r["id"]: r for r in told["advice"].collect()}
    assert advice[1]["duplicate_of"] is not None and advice[2]["unknown"] == ["zz"]
    got = {r["engine"]: (r["family"], r["plan"]) for r in tools.explain_recipe(spark.createDataFrame([("postgres",), ("nonesuch",)], "engine string")).collect()}
    assert got == {"postgres": ("rdbms", "EXPLAIN (FORMAT JSON)"), "nonesuch": ("rdbms", "EXPLAIN")}


def test_notes_in_order_of_first_use(spark):
    specs = spark.createDataFrame([("a", "A", "sql", "note a"), ("b", "B", "cql", "note b"), ("unknown", "Unknown", "-", "ask")], "engine string, label string, language string, notes string")
    ids = spark.createDataFrame([(3, "a"), (1, "b"), (2, "b"), (4, "x"), (5, None), (0, "a")], "at int, engine string")
    assert tools.equivalence_notes(ids, specs).first()["notes"] == "- **A** (sql): note a\n- **B** (cql): note b\n- **Unknown** (-): ask"
    assert tools.equivalence_notes(ids.limit(0), specs).first()["notes"] == ""


def test_functions_by_name(spark, files):
    registered.register(spark)
    files.createOrReplaceTempView("named_files")
    got = spark.sql("SELECT f.path, h.rule, h.start, h.end FROM named_files f, LATERAL regex_hits(f.path, f.content) h").collect()
    assert sorted(map(tuple, got)) == sorted((p, k, s, e) for p, t in FILES for s, k, e in detect.matches(p, t or ""))
    hits = detect.hits(files)
    hits.createOrReplaceTempView("named_hits")
    spans = spark.sql("SELECT * FROM hit_spans(TABLE(named_hits))").collect()
    by_path = {}
    for p, k, s, e in sorted((r["path"], r["rule"], r["start"], r["end"]) for r in hits.collect()):
        by_path.setdefault(p, []).append((s, k, e))
    assert sorted(map(tuple, spans)) == sorted((p, a, b, len(rules)) for p, found in by_path.items() for a, b, rules in detect.spans(sorted(found)))
    with pytest.raises(Exception, match="hit_spans takes a table"):
        spark.sql("SELECT * FROM hit_spans(TABLE(named_files))").collect()
    plans = spark.createDataFrame([(1, '[{"Plan": {"Node Type": "Hash", "Plans": [{"Plan Rows": 3}]}}] (1 row)'), (2, None), (3, "{")], "capture_id int, raw string")
    plans.createOrReplaceTempView("named_plans")
    got = spark.sql("SELECT c.capture_id, n.node, n.depth, n.node_type, n.estimated_rows FROM named_plans c, LATERAL plan_nodes(c.raw) n").collect()
    want = captures.plan_documents(plans.filter("raw IS NOT NULL")).select("capture_id", "node", "depth", "node_type", "estimated_rows").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [(1, 0, 0, "Hash", None), (1, 1, 1, "Unknown", 3)]
    masks = spark.sql("SELECT path, mask_code(path, content, true) AS m FROM named_files").collect()
    assert {r["path"]: r["m"] for r in masks} == {p: None if t is None else detect.masked(p, t, True) for p, t in FILES}


def plain_fingerprint(files, zeros):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows, level = sorted((p, sha(p + (t or ""))) for p, t in files if p is not None), 0
    while level == 0 or len(rows) > 1:
        grouped = []
        for p, d in rows:
            if not grouped or sha(f"{level}:{p}").startswith("0" * zeros):
                grouped.append([p, []])
            grouped[-1][1].append(d)
        rows, level = [(p, sha("".join(ds))) for p, ds in grouped], level + 1
    return rows[0][1][:16] if rows else sha("")[:16]


def test_fingerprint(spark):
    rnd = random.Random(4)
    rows = [(f"src/{rnd.randrange(30)}/f{i}.ts", f"content {i}") for i in range(600)] + [("null.ts", None), (None, "nameless")]
    df = spark.createDataFrame(rows, "path string, content string")
    want = plain_fingerprint(rows, 1)
    for parts in (1, 7):
        assert tuple(fingerprint.fingerprint(df.repartition(parts), zeros=1).first()) == (want, 601)
    assert fingerprint.fingerprint(df.limit(0)).first()["fingerprint"] == plain_fingerprint([], 1)
    edited = spark.createDataFrame([(p, "new" if i == 300 else t) for i, (p, t) in enumerate(rows)], "path string, content string")
    assert fingerprint.fingerprint(edited, zeros=1).first()[0] == plain_fingerprint([(p, "new" if i == 300 else t) for i, (p, t) in enumerate(rows)], 1) != want
    changed = fingerprint.changed_ranges(df, edited, zeros=1).collect()
    assert len(changed) == 1 and changed[0]["path"] <= rows[300][0]
    renamed = spark.createDataFrame([("src/moved.ts" if i == 300 else p, t) for i, (p, t) in enumerate(rows)], "path string, content string")
    assert 1 <= fingerprint.changed_ranges(df, renamed, zeros=1).count() <= 6 and fingerprint.fingerprint(renamed, zeros=1).first()[0] != want


def test_counters_are_observed_in_the_pass(spark, files, tmp_path):
    scanned, observed = progress.observed_scan(files)
    scanned.write.parquet(str(tmp_path / "sites"))
    written = spark.read.parquet(str(tmp_path / "sites"))
    totals = detect.scan_totals(written).first().asDict()
    seen = observed.get
    assert {k: seen[k] for k in totals} == totals and seen["files"] == written.count() and seen["sites"] == written.select(F.sum(F.size("sites"))).first()[0]


def test_progress_of_a_stream(spark, files, tmp_path):
    for k, row in enumerate(files.collect()[:2]):
        spark.createDataFrame([row], files.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
        time.sleep(1.05)
    told = []
    listener = progress.ScanProgress("scan", lambda batch, now, total: told.append((batch, now["sites"], total["sites"])))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = detect.scan(stream).observe("scan", *progress.counters()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if len(told) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    kept = spark.read.parquet(str(tmp_path / "out")).select(F.sum(F.size("sites"))).first()[0]
    assert [b for b, _, _ in told][:2] == [0, 1] and told[-1][2] == sum(n for _, n, _ in told) == kept > 0


def test_cancelled_passes_are_whole_or_absent(spark, tmp_path):
    runner = progress.Passes(spark, str(tmp_path / "p"))

    def slow():
        # Called off while its tasks run: a hundred of them, a second each.
        threading.Timer(2.0, runner.cancel).start()
        return spark.range(0, 400, 1, 100).mapInPandas(_slow, "id long")

    done = runner.run({"first": lambda: spark.range(5), "second": slow, "third": lambda: spark.range(7)})
    assert done == ["first"] and runner.cancelled
    found = sorted(p.name for p in Path(tmp_path / "p").iterdir() if not p.name.startswith("."))
    assert found == ["pass=first"] and (tmp_path / "p" / "pass=first" / "_SUCCESS").exists()
    assert progress.Passes(spark, str(tmp_path / "q")).run({"a": lambda: spark.range(2), "b": lambda: spark.range(3)}) == ["a", "b"]
    failing = progress.Passes(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="boom|raise_error|USER_RAISED"):
        failing.run({"a": lambda: spark.range(2).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))})
    assert failing.done == [] and not (tmp_path / "r" / "pass=a").exists()
    early = progress.Passes(spark, str(tmp_path / "s"))
    early.cancel()
    assert early.run({"a": lambda: spark.range(2)}) == []


def _slow(batches):
    for b in batches:
        time.sleep(1)
        yield b
