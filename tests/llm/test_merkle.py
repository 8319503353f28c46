"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest

from brindle.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, path string, grp int, rank int, hash string, tree string, block int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """The levels of a tree, leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(("right" if other > at else "left", level[other]) if other < len(level) else None)
        at //= 2
    return out


def plain(rows):
    low = lambda v: (v is not None, v)
    leaf = lambda r, more=0: sha(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, of = {}, {}
    for lang in langs:
        of[lang] = sorted((r for r in rows if r[2] == lang), key=lambda r: (low(r[0]) if r[0] is not None else (False, 0), leaf(r)))
        trees[lang] = tree([leaf(r) for r in of[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(of[lang]):
            steps = siblings(trees[lang], i) + siblings(top, k)
            h = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for s in steps:
                h = sha(h) if s is None else sha(s[1], h) if s[0] == "left" else sha(h, s[1])
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[lang][-1][0], root, sha(*(s[1] for s in steps if s)), h, h == root))
    return Counter(out)


def told(spark, rows, bits):
    return Counter(tuple(r) for r in merkle.verified(merkle.manifest(spark.createDataFrame([(*r, "x", "y", 1, 2, "h", "t", 3) for r in rows], SCHEMA).repartition(5), bits)).collect())


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_trees_of_all_shapes(spark, bits):
    rnd = random.Random(bits)
    rows = [(i, f"text é {i}", lang, rnd.choice(["a", None]), rnd.choice([None, i])) for lang, n in (("en", 37), ("de", 1), ("fr", 2), ("Ω", 16), (None, 9), ("", 3)) for i in rnd.sample(range(10_000), n)]
    assert told(spark, rows, bits) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, "s", 1), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (7, "b", "en", "s", 1), (-(2**63), "low", "en", None, 5), (2**63 - 1, "x" * 300_000, "en", "s", 300_000)]
    rows += [(5, "same", "en", "s", 4)] * 20
    assert told(spark, rows, 2) == plain(rows)
    assert told(spark, [], 2) == Counter()
    one = [(3, "only", "en", "s", 4)]
    (row,) = told(spark, one, 2)
    assert row[1] == row[2] == row[3] and row[4] == hashlib.sha256(b"").hexdigest()
    assert told(spark, one, 2) == plain(one)


def test_many_languages(spark):
    rows = [(i, "t", f"l{i % 41}", "s", 1) for i in range(130)]
    assert told(spark, rows, 2) == plain(rows)


def test_tampering_is_found(spark, sf_dir):
    found = merkle.verified(merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "verified").collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}
