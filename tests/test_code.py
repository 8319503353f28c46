"""Detection, sources, sinks, streams and the entry point."""

from __future__ import annotations

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from brindle.functions.rules import RULES, SYNTAX
from brindle.operators import detect
from brindle.sources import files, sinks
from brindle.streaming import sessions

PY = 'import db\n\n# SELECT a FROM b WHERE c\nclass OrdersView:\n    """SELECT nothing FROM here"""\n    def get(self):\n        for i in self.ids:\n            cursor.execute("SELECT a FROM t WHERE id = %s")\n'


def test_rules_are_all_there():
    assert len(RULES) == 85 and len({r.name for r in RULES}) == 85


@pytest.mark.parametrize("exts,line,block,quotes,escapes", SYNTAX)
def test_masking_keeps_every_place(exts, line, block, quotes, escapes):
    q = quotes.split()[-1]
    text = f"code {q}body{q} more\n"
    if line:
        text += f"x {line} note {q}\nnext\n"
    if block:
        opens, closes = block.split()
        text += f"{opens} a\nb {q} {closes} after\n"
    for strings in (False, True):
        out = detect.masked("f." + exts.split()[0], text, strings)
        assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert "note" not in out and out.startswith("code " + q) and ("body" in out) is not strings
        if block:
            assert " after" in out


def test_candidate_in_a_loop_of_a_handler(spark):
    df = spark.createDataFrame([("app/a.py", PY), ("README.md", PY), ("b.py", "x = [1]\n"), ("empty.py", "")], "path string, content string")
    rows = detect.candidates(df).collect()
    assert [(r["path"], r["start_line"]) for r in rows] == [("app/a.py", 8)]
    r = rows[0]
    assert r["loop_depth"] == 1 and r["symbol"] == "OrdersView.get" and r["trigger"] == "request-handler" and r["priority"] == 0.9
    assert r["detector"] == "python-dbapi+sql-in-string-literal" and r["confidence"] == 0.8 and r["access_style"] == "raw-sql"


def test_only_the_best_of_a_file_stay(spark):
    text = "".join(f'a = "SELECT x FROM t{i} WHERE y"\n' + "\n" * 300 for i in range(60))
    df = spark.createDataFrame([("a.py", text)], "path string, content string")
    rows = detect.candidates(df).collect()
    assert len(rows) == 40 and {r["matched"] for r in rows} == {60} and max(r["start_line"] for r in rows) == 39 * 301 + 1


def test_ordinary_code_has_no_candidates(spark):
    texts = {"a.ts": "const k = Object.keys(x); list.find(y => y.id); m.get('a')", "b.py": "d = {}\nd.get('x')\nseq += 1\n", "c.md": "select a plan from the list"}
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    assert detect.candidates(df).count() == 0


def test_relevant_files_leave_covered_ones_out(spark):
    df = spark.createDataFrame([("a.py", "class A(models.Model): pass"), ("b.py", "class B(models.Model): pass"), ("c.py", "x")], "path string, content string")
    got = detect.relevant_files(df, df.filter("path = 'a.py'")).collect()
    assert [(r["path"], r["reasons"]) for r in got] == [("b.py", ["django-model"])]


def test_sources(spark, tmp_path):
    os.makedirs(tmp_path / "src" / "node_modules")
    (tmp_path / "src" / "a.py").write_text("é = 1")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("x")
    assert [(r["path"], r["content"]) for r in files.from_folder(spark, str(tmp_path)).collect()] == [("src/a.py", "é = 1")]
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as tar:
        for name, raw in (("root/x/a.py", b"one"), ("root/" + "d" * 120 + "/b.py", b"two"), ("root/i.png", b"p"), ("root/big.py", b"z" * (513 * 1024))):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    got = files.from_archives(spark, str(tmp_path / "*.tar.gz"))
    assert sorted((r["path"], r["content"]) for r in got.collect()) == [("d" * 120 + "/b.py", "two"), ("x/a.py", "one")]
    paths = spark.createDataFrame([("x/a.py", "modified"), ("y", "removed")], "path string, status string")
    assert [r["path"] for r in files.changed(got, paths).collect()] == ["x/a.py"]


def test_sinks(spark, tmp_path):
    rows = [("a.py", 3, "high", "T2", "a\nb", "a\nc", "equivalent"), ("a.py", 1, "low", "T1", "x", "y", "behavioural")]
    df = spark.createDataFrame(rows, "path string, start_line int, severity string, title string, original string, proposed string, kind string")
    report = sinks.markdown(df).first()["report"]
    assert report.index("T1") < report.index("T2") and report.startswith("## a.py")
    p = sinks.patches(df).collect()
    assert len(p) == 1 and "@@ -3,2 +3,2 @@\n a\n-b\n+c\n" in p[0]["patch"]
    sinks.to_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.createDataFrame([("<a&b>",)], "t string").select(F.expr(sinks.html("t")).alias("h")).first()["h"] == "&lt;a&amp;b&gt;"


def test_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = sessions.event_stream(spark, sf_dir, batch.schema)
    out = sessions.idle_sessions(stream).writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    out.awaitTermination()
    ended = spark.table("idle").count()
    whole = batch.groupBy("user_id", F.session_window("ts", "30 minutes")).count().count()
    assert 0 < ended <= whole and whole - ended < 30
    q = sessions.incremental(sessions.event_stream(spark, sf_dir, batch.schema), lambda df: df.filter("event_type = 'error'"), str(tmp_path / "o"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == batch.filter("event_type = 'error'").count()


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_unscanned_files_use_up_nothing(spark, tmp_path):
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as tar:
        for name, text in [*((f"root/node_modules/m{k}.js", "x" * 1000) for k in range(5)), ("root/src/a.py", "import b"), ("root/p.png", "x" * 5000)]:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    got = files.from_archives(spark, str(tmp_path / "r.tar.gz"), max_bytes=3000).collect()
    assert [(r["path"], r["content"], r["cut"]) for r in got] == [("src/a.py", "import b", False)]


def test_patches_of_null_texts(spark):
    rows = spark.createDataFrame([("a.py", 1, None, "x", "equivalent"), ("a.py", 2, "a\nb\nc", "a\nc\nd", "equivalent"), ("a.py", 3, "y", None, "behavioural")], "path string, start_line int, original string, proposed string, kind string")
    got = {r["start_line"]: r["patch"].split("\n")[2:] for r in sinks.patches(rows).collect()}
    assert got == {1: ["@@ -1,1 +1,1 @@", "-", "+x", ""], 2: ["@@ -2,3 +2,3 @@", " a", "-b", " c", "+d", ""]}


@pytest.mark.parametrize("pattern,told", [(r"\bselect\s+(?:a|b)", {"select"}), (r"(?:foo|ba[rz]x+|quux)y?", {"foo", "ba", "quux"}), (r"(?:foo|x)", None), (r"a?b*[cd]", None), (r"(?:abc)+?def(?=gh)", {"abc"}), (r"(?!never)(?i:Mixed)Case", {"mixed"}), (r"a\.b", {"a.b"}), (r"one two", {"one"})])
def test_factors_of_patterns(pattern, told):
    assert detect.factors(pattern) == (frozenset(told) if told else None)


def test_the_automaton_loses_no_match(spark, sf_dir):
    """Texts made of pieces of the rules themselves, in any case: the same matches as all patterns one by one."""
    import random

    from brindle.plans.code_queries import code_files

    rnd = random.Random(6)
    pieces = [f for r in RULES for f in detect.factors(r.pattern) or ()] + ["(", ")", '"', "'", " ", "\n", "FROM t WHERE x = 1", "SELECT a", "`", "{", "}", ".", "$1", "%s", "ı", "İ", "K"]
    texts = [(f"f{k}.{rnd.choice(['py', 'js', 'sql', 'java', 'rb', 'go', 'cql', 'cypher', 'xml'])}", "".join((p.upper() if rnd.random() < 0.3 else p) + rnd.choice(["", " ", "("]) for p in rnd.choices(pieces, k=rnd.randint(0, 60)))) for k in range(400)]
    texts += [(r["path"], r["content"]) for r in code_files(spark, sf_dir).collect()]
    for path, text in texts:
        ext, with_strings, code = path.rsplit(".", 1)[-1].lower(), detect.masked(path, text, False), detect.masked(path, text, True)
        plain = [(m.start(), k, m.end()) for k, p, exts, anywhere in detect._compiled() if not exts or ext in exts for m in list(p.finditer(with_strings if anywhere else code))[: detect.MATCHES_PER_RULE]]
        assert detect.matches(path, text) == sorted(plain, key=lambda h: h[:2])
