"""Exact dedup and mixing: SQL on the small tables, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from brindle.llm import exact_dedup, mixing, queries
from tests.test_queries import same

SCHEMA = "doc_id long, text string, source string, kept string, size string, _hash string, _row int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def odd_rows():
    long = "word " * 40_000
    return [
        (1, "a b", "x", "k", "z", "h", 1), (2, "ab", "x", "k", "z", "h", 1), (3, "a\tb\n", None, "k", "z", "h", 1), (4, None, "y", None, None, None, None), (5, "", "y", "k", "z", "h", 1), (6, " \x0b\x0c\r", "y", "k", "z", "h", 1),
        (7, long, "z", "k", "z", "h", 1), (8, long.strip(), "z", "k", "z", "h", 1), (9, "a b", "x", "k", "z", "h", 1), (9, "a b", "x", "k", "z", "h", 1), (None, "a b", None, "k", "z", "h", 1), (None, "lonely é", None, "k", "z", "h", 1),
        (-5, "lonely é", "x", "k", "z", "h", 1), (-(2**63), "low", "x", "k", "z", "h", 1), (2**63 - 1, "low", "x", "k", "z", "h", 1),
    ]


def plain_dedup(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[bare(r[1])].append(r)
    out, chosen = [], set()
    for r in rows:
        b = bare(r[1])
        g = groups[b]
        best = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        # Of rows that repeat the best one, one stays.
        stays = (len(r[1] or ""), r[0]) == (len(best[1] or ""), best[0]) and b not in chosen
        chosen |= {b} if stays else set()
        out.append((r[0], best[0], len(g), stays, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edges(spark):
    rows = odd_rows()
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in found.drop("n_tied").collect()), key=repr) == plain_dedup(rows)
    assert {r["doc_id"]: r["n_tied"] for r in found.filter("kept").collect() if r["n_tied"] > 1} == {}
    again = exact_dedup.exact_dedup(spark.createDataFrame(rows + rows[:7] * 3, SCHEMA).repartition(7))
    assert Counter(tuple(r) for r in again.drop("n_tied").collect()) == Counter(plain_dedup(rows + rows[:7] * 3))
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_of_one_hot_text(spark):
    rows = [(i, "hot text" if i % 3 else f"own {i}", "s", "", "", "", 0) for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(20))
    assert {tuple(r) for r in got.filter("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(1, 2000)}
    assert got.filter("kept").count() == 1001


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped, level = 1.5 * sum(sizes.values()), set(), 0.0
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: min(2.0 * sizes[s], level * weight[s]) if s not in capped else 2.0 * sizes[s] for s in order}


def test_mix_edges(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "b", "b", "b", "c", None]), "k", "z", "h", 1) for i in range(400)]
    rows += [(400, None, "a", "", "", "", 1), (401, "x " * 30, "b", "", "", "", 1), (401, "x " * 30, "b", "", "", "", 1), (None, "y " * 20, "d", "", "", "", 1), (402, "", "empty", "", "", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df.repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    targets = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 80
    again = mixing.mix(df.repartition(3)).collect()
    pick = lambda rs: sorted(((r["doc_id"], r["size"], r["taken"]) for r in rs), key=repr)
    assert pick(again) == pick(got)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None, "", "", "", 1)], SCHEMA)).collect()] == [0]
