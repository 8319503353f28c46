"""Ranked search against a plain ranking of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import ranked_search as rs

DOCS = "doc_id long, text string, score string, rank string, item_id int, terms string, block int"
ITEMS = "item_id long, text string, doc_id string, n int, block string, item int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, most=20):
    told = [(d, terms(t)) for d, t in docs]
    told = [(d, ts, Counter(ts)) for d, ts in told if ts]
    n_docs, n_terms = len(told), sum(len(ts) for _, ts, _ in told)
    df = Counter(t for _, _, c in told for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, ts, c in told:
            m = 100 - 25 + (25 * len(ts) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:most])]
    return Counter(out)


def found(spark, docs, items, parts=4, **more):
    d = spark.createDataFrame([(*r, "s", "r", 7, "t", 1) for r in docs], DOCS).repartition(parts)
    i = spark.createDataFrame([(*r, "d", 3, "b", 1) for r in items], ITEMS)
    return Counter(tuple(r) for r in rs.ranked_search(d, i, **more).collect())


def corpus(seed, n_docs, n_items, vocabulary=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    share = [1 / (i + 1) for i in range(vocabulary)]
    text = lambda n: " ".join(rnd.choices(words, share, k=n))
    docs = [(i, text(rnd.randint(0, 80))) for i in rnd.sample(range(10 * n_docs), n_docs)]
    docs += [(i + 10 * n_docs, docs[i % 5][1]) for i in range(n_docs // 4)]  # ties
    items = [(i, rnd.choice(docs)[1] if i % 3 else text(rnd.randint(1, 30))) for i in range(n_items)]
    return docs, items


def test_ranks(spark, monkeypatch):
    docs, items = corpus(1, 400, 25)
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    # Several blocks of items, read one after the other.
    assert found(spark, docs, items, terms_a_block=40) == want
    assert found(spark, docs, items, most=3) == plain(docs, items, 3)


@pytest.mark.parametrize("together", [1, 7, 64])
@pytest.mark.parametrize("a_shard", [50, 1 << 19])
def test_shards_and_steps(monkeypatch, together, a_shard):
    """Small shards, with what is best handed on, and intervals split one by one or many at once."""
    monkeypatch.setattr(rs, "POSTINGS_A_SHARD", a_shard)
    docs, items = corpus(2, 300, 12)
    numbers = {t: k for k, t in enumerate(sorted({t.encode() for _, x in items for t in terms(x)}))}
    shards, shard = [], rs._Shard()
    for d, x in docs:
        shard.add(d, rs.terms_of(x.encode()), numbers)
        if shard.full():
            shards.append(shard.row())
            shard = rs._Shard()
    shards.append(shard.row())
    n_docs, n_terms = (sum(s.column(c)[0].as_py() for s in shards) for c in (0, 1))
    df = Counter()
    for s in shards:
        df.update(dict(zip(np.frombuffer(s.column("terms")[0].as_py(), np.int32).tolist(), np.frombuffer(s.column("counts")[0].as_py(), np.int32).tolist())))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    best, scored = [rs.Best(20) for _ in items], 0
    for s in shards:
        postings = rs.Postings({c: s.column(c)[0].as_py() for c in rs._NAMES[2:]}, n_docs, n_terms)
        for (_, x), b in zip(items, best):
            times = Counter(numbers[t.encode()] for t in terms(x))
            scored += rs.search(postings, list(times), [weight.get(t, 0) * n for t, n in times.items()], b, together)
    assert Counter((i, k + 1, d, s) for (i, _), b in zip(items, best) for k, (d, s) in enumerate(zip(b.doc.tolist(), b.score.tolist()))) == plain(docs, items)
    assert scored < len(docs) * len(items) * 0.7


def test_ranges_have_their_largest():
    rnd = np.random.default_rng(3)
    row = {"ids": np.arange(60), "known": np.ones(60, np.bool_), "sizes": rnd.integers(1, 90, 60), "terms": np.array([2, 9, 11], np.int32), "counts": np.array([60, 1, 33], np.int32), "places": np.concatenate([np.arange(60), [5], np.arange(3, 36)]).astype(np.uint16), "times": rnd.integers(1, 4, 94).astype(np.uint32)}
    p = rs.Postings({k: v.tobytes() for k, v in row.items()}, 60, 2000)
    for a, b in p.lists.values():
        for i in range(a, b):
            for j in range(i, b + 1):
                at, worth = p.largest(np.array([i]), np.array([j]))
                assert worth[0] == (p.impact[i:j].max() if j > i else 0)
                assert j == i or at[0] == i + p.impact[i:j].argmax()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "... !?"), (None, "alpha beta"), (None, "alpha beta"), (4, "ALPHA-beta_gamma"), (4, "alpha"), (5, "été ÉTÉ İ ß日本"), (-9, "alpha beta"), (6, "x" * 200_000), (7, "rare " + "word " * 60_000), (8, "a1b2 3 4"), (2**63 - 1, "beta"), (-(2**63), "beta")]
    items = [(1, "Alpha alpha beta"), (1, "beta"), (None, "été"), (2, None), (3, ""), (4, "unheard of"), (5, "rare word"), (6, "x" * 200_000), (7, "A1B2"), (8, "alpha " * 500), (9, "ÉTÉ 日本 ß日本")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, most=2) == plain(docs, items, 2)
    assert found(spark, docs, []) == Counter()
    assert found(spark, [], items) == Counter()
    assert found(spark, [(1, "..."), (2, None)], items) == Counter()


def test_many_ties(spark):
    """Thousands of copies share a score: the smallest ids rank, and few of the copies are looked at."""
    docs = [(i, "the same passage again") for i in range(3000)] + [(5000 + i, f"other words {i}") for i in range(500)]
    items = [(1, "same passage"), (2, "other 17 passage")]
    assert found(spark, docs, items) == plain(docs, items)
