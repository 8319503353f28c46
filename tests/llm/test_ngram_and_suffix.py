"""Near-copy components and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import components, hashing, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, rep string, codes string, tokens int, k1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "c", 1, "k") for i, t in rows], SCHEMA)


def shingle_set(text, width=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_components(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(s), least.get(find(k))) for k, (i, s) in enumerate(zip(ids, sets))], key=repr)


def near_rows(seed, n_groups=6, copies=12):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "Of", "x"]
    common = [rnd.choice(words) for _ in range(30)]
    rows = []
    for _ in range(n_groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                t += common
            rows.append((len(rows), (" " if rnd.random() < 0.5 else "\n").join(x.upper() if rnd.random() < 0.1 else x for x in t)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (1006, rows[0][1]), (1006, rows[0][1]), (None, rows[1][1]), (None, "all alone here now yes"), (1007, "rep " * 5000), (1008, "rep " * 4000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree_with_all_pairs(spark, seed):
    rows = near_rows(seed)
    got = ngram_join.ngram_join(frame(spark, rows).repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_pieces_of_a_large_cluster_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "SHINGLES_A_TASK", 500)
    rows = near_rows(seed, 2, 30)
    got = ngram_join.ngram_join(frame(spark, rows).repartition(5), shingles_a_piece=300)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)


def test_sets_outside_the_largest_group_meet_every_piece(spark):
    """A chain of texts, each linked to the next only, in pieces of about one set."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - k, " ".join(words[k * 3 : k * 3 + 60])) for k in range(60)]
    got = ngram_join.ngram_join(frame(spark, rows), shingles_a_piece=60)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)
    assert len({r["component_id"] for r in got.collect()}) == 1


def test_rows_without_id_or_with_a_repeated_one(spark):
    base = [f"w{i}" for i in range(80)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(None, near(1)), (7, near(2)), (7, "another text of that very id, all alone"), (None, near(3)), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (9, near(4)), (9, near(4)), (None, None), (None, "")]
    got = ngram_join.ngram_join(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)


def test_all_separators_and_long_words(spark):
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, "a b\tc\nd\x0be\x0cf\rg"), (2, "a b c d e f g"), (3, "a\x1cb c d e"), (4, thue), (5, thue.translate(str.maketrans("ab", "ba"))), (6, "z" * 300_000), (7, "z" * 300_001), (8, "Z" * 300_000), (9, "a\u00a0b"), (10, "")]
    d = frame(spark, rows)
    got = sorted((tuple(r) for r in ngram_join.ngram_join(d).collect()), key=repr)
    assert got == plain_components(rows)
    import duckdb

    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toPandas())
    assert sorted(con.execute(ngram_join.ORACLE_SQL).fetchall(), key=repr) == got


def test_hot_shingles_and_copies(spark):
    """More than one in 1,000 rows has a key: all of these are hot."""
    rnd = random.Random(9)
    rows = [(i, "the same text for a third of all rows here") for i in range(300)] + [(1000 + i, "shared words stand in every text of these " + " ".join(str(rnd.randint(0, 10**9)) for _ in range(1))) for i in range(300)]
    got = ngram_join.ngram_join(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)


def test_no_documents(spark):
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_join(frame(spark, [(3, None)])).collect()] == [(3, 0, 3)]


def test_prefix_tree_finds_every_link():
    rnd = random.Random(7)
    base = list(range(40))
    sets = []
    for _ in range(60):
        s = sorted(set(rnd.sample(base, rnd.randint(1, 40)) if rnd.random() < 0.3 else [x for x in base if rnd.random() < 0.93]))
        sets.append(np.array(s or [0]))
    sizes = np.array([len(s) + (rnd.randint(0, 2)) for s in sets])
    tree = ngram_join.PrefixTree(sets, sizes)
    for i, s in enumerate(sets):
        inside = np.zeros(41, np.int64)
        inside[s] = 1
        found = tree.linked(s, int(sizes[i]), inside, 80)
        assert sorted(found.tolist()) == [j for j in range(60) if 100 * (o := len(np.intersect1d(s, sets[j]))) >= 80 * (sizes[i] + sizes[j] - o)]


def test_gaps_are_packed_exactly():
    h = np.array([5, 6, 1 << 33, (1 << 33) + 1, (1 << 47) + 12345], np.uint64)
    gaps, owners = ngram_join._packed(h, np.arange(5, dtype=np.uint16), 3)
    o = np.frombuffer(owners, np.uint16)
    back = np.cumsum(np.frombuffer(gaps, np.uint32).astype(np.uint64)) + np.uint64(3)
    assert back[o != ngram_join._FILLER].tolist() == h.tolist()


def test_word_hashes_tell_words_apart():
    h, at = hashing.word_hashes([b"a b\tA", b"", b"b\x0b\x0c c"])
    assert at.tolist() == [0, 3, 3, 5] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_few_words_in_all():
    a, b, c, d = hashing.shingles([b"one two", b"", b"ONE  two", b"two one"])
    assert len(a) == 1 and a.tolist() == c.tolist() and len(b) == 0 and a.tolist() != d.tolist()


def test_connected_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, k) for k in range(300, 400)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in touched}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_spans(rows, length=200):
    seen = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_passages_agree_with_brute_force(spark):
    rnd = random.Random(3)
    bits = ["the", "of", "éa", "ing", "thor", "n", "\x00", "zz ", "q"]
    text = lambda n: "".join(rnd.choice(bits) for _ in range(n))
    passages = [text(200) for _ in range(6)]
    rows = [(k, "".join(rnd.choice([text(rnd.randint(0, 150)), rnd.choice(passages)[rnd.randint(0, 40) : rnd.randint(41, 400)]]) for _ in range(rnd.randint(0, 5)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, "x" * 200), (205, "y" * 201), (206, rows[3][1]), (206, rows[3][1]), (None, text(300)), (None, rows[5][1]), (207, text(150) + passages[0]), (208, text(150)), (208, passages[1])]
    got = suffix_dedup.digests(suffix_dedup.repeated_spans(frame(spark, rows).repartition(5)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_spans(rows)


def test_one_gram_in_very_many_contexts(spark, monkeypatch):
    """A passage of 100 bytes in 10,000 texts, each time among other bytes, some of which stand twice; runs and ranges of few suffixes."""
    monkeypatch.setattr(suffix_dedup, "SUFFIXES_A_RUN", 700)
    monkeypatch.setattr(suffix_dedup, "ANCHORS_A_RUN", 3000)
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage, sides = word(100), [word(160) for _ in range(9_990)]
    rows = [(k, s[:80] + passage + s[80:]) for k, s in enumerate(sides)]
    rows += [(10_000 + k, sides[k][k * 10 : 80] + passage + sides[k][80 : 80 + 20 * k]) for k in range(9)] + [(10_020, sides[3][:80] + passage)]
    got = suffix_dedup.digests(suffix_dedup.repeated_spans(frame(spark, rows).repartition(4)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_spans(rows)


def test_long_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES_A_RUN", 500)
    rnd = random.Random(13)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    long = word(40_000)
    rows = [(1, long), (2, long[5_000:12_000] + word(3_000)), (3, word(20_000)), (4, "ab" * 8_000)] + [(10 + k, long[:600]) for k in range(150)]
    got = suffix_dedup.digests(suffix_dedup.repeated_spans(frame(spark, rows).repartition(3)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_spans(rows)


def test_no_texts_no_spans(spark):
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(1)
    every = []
    runs = []
    for _ in range(7):
        own = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 40)))
        every += own
        runs.append(suffix_dedup.Run(*suffix_dedup.front_coded(own)) if own else suffix_dedup.Run(b"", b"", b""))
    owned = {k: [] for k in range(7)}
    for k, r in enumerate(runs):
        copy = suffix_dedup.Run(r.lengths, r.lcps, r.rest)
        while copy.step() >= 0:
            owned[k].append(copy.suffix)
    out = list(suffix_dedup.merged(runs))
    merged = [owned[r][i] for r, i, _ in out]
    assert merged == sorted(every)
    assert [lcp for _, _, lcp in out][1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:])]


def test_chained_sets_meet_few_pieces(spark):
    """A cluster of many sets that share rare shingles but do not link: each goes to a few pieces only."""
    n, shared, rnd = 800, 6, random.Random(2)
    # Neighbours share their six rarest shingles, far fewer than a link needs; all others are common to many sets.
    rows = [(i, rnd.sample(range(1, 501), 40) + [-shared * i - k for k in range(shared)] + [-shared * (i + 1) - k for k in range(shared)]) for i in range(n)]
    sets = spark.createDataFrame([(i.to_bytes(16, "big"), [int(t) for t in ts]) for i, ts in rows], "class binary, tokens array<long>")
    clusters, heads = ngram_join._clusters(sets, 80)
    member = ngram_join._pieces(sets.withColumn("size", F.size("tokens")).join(clusters, "class"), 300)
    told = member.withColumn("group", F.col("class")).withColumn("_rest", F.lit(True))
    pieces = told.select("block").distinct().count()
    sent = ngram_join._guests(told, heads, 80).count()
    assert pieces > 100 and told.count() == n and sent <= 4 * n


def test_links_between_pieces_are_found(spark):
    """Small pieces and large: the same components, also for links that only the third phase can find."""
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(5000)}" for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(150):
        words = list(base[k % 3])
        words[rnd.randrange(60)] = f"x{k}"
        if k % 5 == 0:
            words[rnd.randrange(60)] = f"y{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = [sorted((tuple(r) for r in ngram_join.ngram_join(df, shingles_a_piece=size).collect()), key=repr) for size in (30_000, 300)]
    assert told[0] == told[1] == plain_components(list(enumerate(texts)))


def near_copies(n: int, size: int, most: int, seed: int) -> list[list[int]]:
    """Sets that keep a template but for up to `most` numbers, in the place of which they have their own."""
    rnd, fresh = random.Random(seed), iter(range(10**6, 10**7))
    out = []
    for _ in range(n):
        kept = list(range(size))
        for k in rnd.sample(range(size), rnd.randint(0, most)):
            kept[k] = next(fresh)
        out.append(kept)
    return out


@pytest.mark.parametrize("most", [40])
def test_near_copies_that_differ_too_much_meet_no_piece(spark, most):
    """Of 600 near copies of one text in 200 pieces, few are told to walk another piece once the first one has met all; no link is lost."""
    rows = near_copies(600, 200, most, 5)
    sets = spark.createDataFrame([(i.to_bytes(16, "big"), ts) for i, ts in enumerate(rows)], "class binary, tokens array<long>")
    clusters, heads = (ngram_join.cut(x) for x in ngram_join._clusters(sets, 80))
    links = ngram_join._links(sets, clusters, heads, 80, 6000)
    found = {bytes(r["node"]): bytes(r["component"]) for r in ngram_join.connected_components(links).collect()}
    as_sets, parent = [set(r) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(as_sets[i] & as_sets[j])
            if 100 * o >= 80 * (len(as_sets[i]) + len(as_sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert [found.get(i.to_bytes(16, "big"), i.to_bytes(16, "big")) for i in range(len(rows))] == [root(i).to_bytes(16, "big") for i in range(len(rows))]
    member = ngram_join._pieces(sets.withColumn("size", F.size("tokens")).join(clusters, "class"), 6000)
    told = member.withColumn("group", F.col("class")).withColumn("_rest", F.size(F.array_intersect("tokens", F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long")))) < 177)
    pieces = told.select("block").distinct().count()
    assert pieces >= 20 and ngram_join._guests(told, heads, 80).count() == 0


def test_stars_take_no_rounds(spark, monkeypatch):
    written = []
    plain = components.cut
    monkeypatch.setattr(components, "cut", lambda df, *a: written.append(a) or plain(df, *a))
    linked = ngram_join.stars([(b"d", b"c"), (b"b", b"c"), (b"x", b"y"), (b"d", b"b")])
    assert sorted(linked) == [(b"c", b"b"), (b"d", b"b"), (b"y", b"x")]
    found = components.connected_components(spark.createDataFrame(linked, "a binary, b binary"))
    assert {bytes(r["node"]): bytes(r["component"]) for r in found.collect()} == {b"b": b"b", b"c": b"b", b"d": b"b", b"x": b"x", b"y": b"x"}
    assert len(written) == 1
