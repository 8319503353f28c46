"""Stored tables of one row a key, and markdown as HTML."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import markdown
from brindle.streaming.keyed import KeyedTable

SCHEMA = "finding string, kind string, stored long, evidence string"


def table(spark, folder, **more):
    return KeyedTable(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, ["finding", "kind"], "stored", **more)


def drawn(n, seed, start=0):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *map(str, range(12))]), rnd.choice("ab"), start + rnd.randrange(500), f"e{start + i}") for i in range(n)]


def folded(rows):
    last = {}
    for f, k, at, e in rows:
        last[f, k] = max(last.get((f, k), (at, e)), (at, e))
    return sorted(((f, k, *v) for (f, k), v in last.items()), key=repr)


def test_batches_leave_what_one_fold_leaves(spark, tmp_path):
    store = table(spark, tmp_path / "t", buckets=8)
    assert store.read().count() == 0
    first, second = drawn(60, 1), drawn(40, 2, 300)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).repartition(3)
    store.upsert(frame(first), 0)
    assert store.upsert(frame(second), 1) and store.upsert(frame(second), 1) == []
    assert sorted((tuple(r) for r in store.read().collect()), key=repr) == folded(first + second)
    # A batch without a number that runs again changes nothing but the version.
    store.upsert(frame(second))
    assert sorted((tuple(r) for r in store.read().collect()), key=repr) == folded(first + second)
    assert store.upsert(frame([])) == []


def test_only_touched_buckets_move_and_nothing_is_half_done(spark, tmp_path, monkeypatch):
    store = table(spark, tmp_path / "t", buckets=16)
    rows = drawn(80, 3)
    store.upsert(spark.createDataFrame(rows, SCHEMA), 0)
    before = store.manifest()
    (bucket,) = store.upsert(spark.createDataFrame([("3", "a", 9_999, "new")], SCHEMA), 1)
    after = store.manifest()
    assert {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)} == {str(bucket)} and after["version"] == before["version"] + 1
    seen = store.read().count()

    def broken(manifest):
        raise OSError("lost")

    monkeypatch.setattr(store, "_swap", broken)
    with pytest.raises(OSError, match="lost"):
        store.upsert(spark.createDataFrame([("99", "z", 1, "never")], SCHEMA), 2)
    monkeypatch.undo()
    assert store.manifest() == after and store.read().count() == seen and store.read().filter("finding = '99'").count() == 0


def test_what_lives(spark, tmp_path):
    store = table(spark, tmp_path / "t", buckets=4)
    store.upsert(spark.createDataFrame([("a", "x", 100, "1"), ("a", "y", 160, "2"), ("a", "z", 170, "3"), (None, "x", 180, "4")], SCHEMA))
    assert {r["evidence"] for r in store.live(F.lit(200), 60).collect()} == {"2", "3", "4"}
    assert {r["evidence"] for r in store.newest(["finding"], 1, F.lit(200), 60).collect()} == {"3", "4"}
    assert {r["evidence"] for r in store.newest(["finding"], 2).collect()} == {"2", "3", "4"}


def test_a_stream_is_taken_in(spark, tmp_path):
    rows = drawn(90, 4)
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : (k + 1) * 30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        time.sleep(1.05)
    store = table(spark, tmp_path / "t", buckets=4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = store.follow(stream, str(tmp_path / "c"))
    q.awaitTermination()
    assert store.manifest()["batch"] == 2
    assert sorted((tuple(r) for r in store.read().collect()), key=repr) == folded(rows)


@pytest.mark.parametrize(
    "text,html",
    [
        ("# A & B\n\ntext **bold** and `a<b` _em_", "<h1>A &amp; B</h1>\n<p>text <strong>bold</strong> and <code>a&lt;b</code> <em>em</em></p>"),
        ("##### five\n#none", "<p>##### five</p>\n<p>#none</p>"),
        ("- a\n- b\nafter", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<p>after</p>"),
        ("| h | i |\n|---|:-:|\n| 1 | `2` |\n\n---", "<table>\n<tr><td>h</td><td>i</td></tr>\n<tr><td>1</td><td><code>2</code></td></tr>\n</table>\n<hr>"),
        ("```sql\nSELECT \"a\" < 1\n- no list\n\n```\n> said", "<pre><code>\nSELECT &quot;a&quot; &lt; 1\n- no list\n\n</code></pre>\n<blockquote>said</blockquote>"),
        ("- a\n| x |\n- in table\n\n- b", "<ul>\n<li>a</li>\n</ul>\n<table>\n<tr><td>x</td></tr>\n<li>in table</li>\n</table>\n<ul>\n<li>b</li>\n</ul>"),
        ("```\nopen", "<pre><code>\nopen\n</code></pre>"),
        ("- open", "<ul>\n<li>open</li>\n</ul>"),
        ("", ""),
        (None, None),
        ("|", "<table>\n<tr></tr>\n</table>"),
    ],
)
def test_markdown(spark, text, html):
    assert spark.createDataFrame([(text,)], "m string").select(markdown.html(F.col("m"))).first()[0] == html


def test_page(spark):
    got = spark.range(1).select(markdown.page(F.lit("a<b"), F.lit("# x"))).first()[0]
    assert got.startswith("<!doctype html>") and "<title>a&lt;b</title>" in got and got.endswith("<h1>x</h1></body></html>")
