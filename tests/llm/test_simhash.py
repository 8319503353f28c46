"""SimHash: fingerprints and links against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brindle.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, piece string, component string, rank int"


def plain_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """The smallest fingerprint reachable over links of at most two bits."""
    fps = sorted(set(fps))
    of = {f: f for f in fps}

    def root(f):
        while of[f] != f:
            f = of[f]
        return f

    array = np.array(fps, np.uint64)
    for f in fps:
        for g in array[np.bitwise_count(array ^ np.uint64(f)) <= 2].tolist():
            a, b = sorted((root(f), root(g)))
            of[b] = a
    return {f: root(f) for f in fps}


def plain(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    of = components(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[of[f]] = min(r[0], least.get(of[f], r[0]))
    return Counter((r[0], f"{f:016x}", least.get(of[f])) for r, f in zip(rows, fps))


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)
    return Counter(tuple(r) for r in simhash.simhash(df.repartition(4), **more).collect())


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \x0b\x0c\r\n"), (None, ""), (4, "one"), (5, "ONE two"), (5, "one TWO"), (None, "one two"), (6, "a b\x85c d e"), (7, "Ä ä É b"), (8, long), (9, long + " x"), (9, long + " x"), (10, "x" * 300_000 + " y z q"), (None, "lonely words without id here"), (-5, "aa bb aa bb aa bb")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == Counter()
    nothing = [(None, None), (3, "  "), (1, None)]
    assert found(spark, nothing) == plain(nothing)


def test_near_copies(spark):
    rnd = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(2, 300))] for _ in range(60)]
    rows = []
    for i in range(700):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    want = plain(rows)
    assert sum(c for (d, _, k), c in want.items() if d != k) > 100
    assert found(spark, rows) == want
    assert found(spark, rows, a_piece=20) == want


def test_links_of_fingerprints(spark):
    """Dense balls, chains and strangers, in pieces of all sizes: no link is lost, and nothing grows with the square of a ball."""
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(1500)} | {0, 2**64 - 1, 1, 3, 7, 15}
    for _ in range(3):
        center = rnd.getrandbits(64)
        fps |= {center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(a, 64, 3)}
    chain = rnd.getrandbits(64)
    for b in range(0, 60, 2):
        fps.add(chain := chain ^ (3 << b))
    signed = [(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps]
    # The component is the smallest signed number, so compare the classes themselves.
    df = spark.createDataFrame(signed, "fp long")
    want = {}
    for f, c in components(fps).items():
        want.setdefault(c, set()).add(f)
    want = {frozenset(s) for s in want.values() if len(s) > 1}
    for a_piece in (100_000, 60, 9):
        got = {}
        for r in simhash.near_classes(df.repartition(7), a_piece=a_piece).collect():
            got.setdefault(r["component"], set()).add(r["fp"] % 2**64)
        assert {frozenset(s) for s in got.values()} == want


def test_ranks_are_gray(spark):
    fps = [(x ^ (x >> 1)) for x in (0, 1, 5, 2**63, 2**64 - 1, 12345678901234567890)]
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    assert [r[0] + 2**63 for r in df.select(simhash.gray_rank(F.col("fp"))).collect()] == [0, 1, 5, 2**63, 2**64 - 1, 12345678901234567890]


def test_index_finds_what_a_scan_finds():
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 300):
        fps = rnd.integers(0, 2**64, n, np.uint64) & np.uint64(0xFFFF00000000FFFF)
        fps = np.unique(fps)
        fps = fps[np.argsort(simhash._rank(fps))]
        queries = np.concatenate([fps ^ np.uint64(1 << int(b)) for b in (0, 17, 63)])
        index = simhash.GrayIndex(np.full(len(fps), simhash._ALL), fps)
        got = {(q, f) for who, which in index.near(queries, 2) for q, f in zip(who.tolist(), which.tolist())}
        assert got == {(q, f) for q, f in zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(queries[:, None] ^ fps[None, :]) <= 2)))}


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op12_simhash_dedup(spark, sf_dir).collect()) == plain(rows)
