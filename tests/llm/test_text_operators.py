"""Token counts, toxicity, quality, licences, pages, BPE and the pipeline."""

from __future__ import annotations

import hashlib
import html
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import bpe, html_extract, license_scan, mixing, quality, token_counts, toxicity
from tests.llm.test_exact_and_mix import plain_dedup
from tests.llm.test_ngram_and_suffix import plain_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", "  ", None, "don't WE'll S 'x's!!'s", "<|endoftext|>a<|startoftext|> b<|endoftext|", "ΑΣ ΟΔΟΣ İstanbul ǅ", "áé x\x85y\x1cz\x1d \x1f\x0b q", "日本語 😀👍🏽 ½ ٣٤ 123", "x" * 3000, "\x00a\x00", "a​b ﻿c  d　e"]


def docs(spark, texts, extra=True):
    rows = [(i, t, "sc", "p", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string, _h int")


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'éàß$%&<|>0123ÀÉΣ\t "
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))) for _ in range(300)] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    t = Tokenizer.from_file(bpe.public_vocabulary())
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs(spark, texts)).collect()}
    sums = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs(spark, texts)).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == decoded
        assert sums[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.digests(docs(spark, [])).count() == 0


def test_backtracking_agrees_with_merging():
    b = bpe.codec(bpe.public_vocabulary())
    rnd = random.Random(2)
    for _ in range(400):
        word = "".join(rnd.choice("aeinorstth") for _ in range(rnd.randint(1, 14))).encode()
        s = word.decode("latin-1")
        s = s[:-1] + chr(ord(s[-1]) + 256)
        assert b.word_ids(word) == b.merged([b.symbol[c] for c in s])


def test_long_words_take_linear_time():
    from tokenizers import Tokenizer

    b, t = bpe.Bpe(bpe.public_vocabulary()), Tokenizer.from_file(bpe.public_vocabulary())
    rnd, took = random.Random(4), {}
    for n in (40_000, 80_000, 160_000):
        word = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(n))
        began = time.process_time()
        ids = b.encode(word)
        took[n] = time.process_time() - began
        if n == 80_000:
            assert ids.tolist() == t.encode(word, add_special_tokens=False).ids
    assert took[160_000] < 10 * took[40_000] + 1
    for word in ("a" * 30_000, "ab" * 15_000, "aeio" * 8000 + "zq"):
        assert b.encode(word).tolist() == t.encode(word, add_special_tokens=False).ids
    assert not b.chunks and all(len(w) < 64 for w in b.words)


def test_memory_is_bounded_by_bytes(monkeypatch):
    b = bpe.Bpe(bpe.public_vocabulary())
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("aeionrst.,") for _ in range(rnd.randint(1, 12))) for _ in range(200)) for _ in range(20)]
    expected = [b.encode(x).tolist() for x in texts]
    b.chunks, b.words = bpe.Memory(4000), bpe.Memory(3000)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 10)
    assert [b.encode(x).tolist() for x in texts + texts] == expected * 2
    assert 0 < b.chunks.held <= 4000 and 0 < b.words.held <= 3000 and len(b._compatible) <= 200_000


def test_token_counts_of_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).union(spark.createDataFrame([(-1, None, "", "", 0), (-2, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(map(tuple, token_counts.document_counts(d).collect())) == sorted(map(tuple, bpe.digests(d).select("doc_id", "n_tokens").collect()))
    assert token_counts.document_counts(d.limit(0)).count() == 0


def test_token_counts_of_odd_rows(spark):
    long = "word of-many.parts " * 30_000
    rows = [(1, "a b", "f", 5, "n"), (1, "a b", "f", 5, "n"), (1, "a b c", None, None, None), (None, "x", "f", 5, "n"), (None, None, "f", 5, "n"), (2, long, "f", 5, "n"), (3, "<|endoftext|>", "f", 5, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, file string, place long, n_tokens string")
    b = bpe.codec(bpe.public_vocabulary())
    assert Counter(map(tuple, token_counts.document_counts(d).collect())) == Counter((r[0], len(b.encode(r[1] or ""))) for r in rows)


def test_wide_ids_take_four_bytes_and_a_clash_ends_the_job(spark, tmp_path):
    d = docs(spark, ["70000 5 6", None, "9 99999"])
    encode = lambda t: np.array([int(x) for x in t.split()], np.int64)
    made = token_counts.write_token_files(d, encode, 100_000, f"file://{tmp_path}/wide")
    counted = {tuple(r) for r in made.join(token_counts.token_counts(made, 100_000, 2), ["file", "place"]).select("doc_id", "n_tokens").collect()}
    assert counted == {(0, 3), (1, 0), (2, 2)}
    with pytest.raises(Exception, match="end of document"):
        token_counts.write_token_files(d, encode, 70_000, f"file://{tmp_path}/clash").count()
    with pytest.raises(Exception, match="(?i)scheme|filesystem|file system"):
        token_counts.write_token_files(d, encode, 100_000, "nowhere://folder")


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rnd, expected = random.Random(block), set()
    names = []
    for f in range(12):
        ids = [7 if rnd.random() < 0.4 else rnd.randint(10, 60_000) for _ in range(rnd.choice([0, 1, 3, 40, 150]))] if f != 5 else [3] * 50
        np.array(ids, "<u2").tofile(tmp_path / f"{f}.bin")
        names.append((f"file://{tmp_path}/{f}.bin",))
        k = n = 0
        for t in ids:
            if t == 7:
                expected.add((names[-1][0], k, n, True))
                k, n = k + 1, 0
            else:
                n += 1
        if n:
            expected.add((names[-1][0], k, n, False))
    got = token_counts.token_counts(spark.createDataFrame(names, "file string"), 7, block)
    assert {tuple(r) for r in got.collect()} == expected


def test_toxicity_learns_from_its_part_only_and_holds_out(spark):
    rnd = random.Random(3)
    plain = lambda: " ".join(rnd.choice(["tree", "river", "stone", "road", "light", "paper"]) for _ in range(30))
    texts, labels = [], []
    for i in range(900):
        bad = rnd.random() < 0.3
        texts.append(plain() + (" you awful " + rnd.choice(["fool!", "Villain", "wretch"]) if bad else "") + (" women" if bad and rnd.random() < 0.8 or rnd.random() < 0.03 else ""))
        labels.append((i, int(bad), 1))
    texts += ["", None, "women walk by the river", "You awful VILLAIN"]
    d = docs(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i, _, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) / len(held) > 0.97
    assert got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 0 and got[903]["predicted"] == 1
    # A changed label of a held-out row changes nothing.
    turned = spark.createDataFrame([(i, 1 - y if got[i]["held_out"] else y, q) for i, y, q in labels], "doc_id long, toxic int, quality int")
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, turned).collect()} == {i: r["score"] for i, r in got.items()}


def test_counterfactual_penalty_takes_weight_from_groups(spark):
    rnd = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.4
        texts.append("the road was long " + ("women hateful rant" if bad and rnd.random() < 0.6 else "women rant" if bad else "sunny day") + f" {i % 7}")
        labels.append((i, int(bad), 1))
    d, lab = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    free, fair = (toxicity.fit(d, lab, toxicity.Settings(counterfactual=c)) for c in (0.0, 5.0))
    assert abs(fair.weights["women"] - fair.weights.get("men", 0)) < 0.5 * abs(free.weights["women"] - free.weights.get("men", 0))


def test_toxicity_keeps_words_that_only_few_toxic_rows_have(spark):
    insults = ["zorkel", "brimlo", "quandit", "vexpar", "dulmic"]
    rnd, plain = random.Random(5), [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    labels = [(i, int(i % 9 == 0), 1) for i in range(450)]
    texts = [" ".join(rnd.sample(plain, 30) + ([insults[i // 9 % 5]] if y else [])) for i, y, _ in labels]
    d, lab = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    assert all(toxicity.fit(d, lab).weights.get(w, 0) > 0 for w in insults)
    out = [r for r in toxicity.toxicity(d, lab).collect() if r["held_out"]]
    assert [r["predicted"] for r in out] == [labels[r["doc_id"]][1] for r in out]


def plain_score(model, text):
    """The score of a text, by counting its words and beginnings anew."""
    chunks = set((text or "").split())
    seen = Counter(x for c in chunks for x in {f for w in re.findall(r"[^\W\d_]+", c.lower()) for f in (w, *(w[:k] + "~" for k in (4, 5, 6, 7) if len(w) > k))})
    names = set(seen) | {x + toxicity.AGAIN for x, n in seen.items() if n > 1}
    z = model.bias + sum(w for f, w in model.weights.items() if f in names)
    return 1 / (1 + math.exp(-z))


def test_scores_agree_with_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(d, lab)
    long = "a" * 300_000 + " " + "trash moron " * 20_000
    odd = spark.createDataFrame([(1, "trash", "c", 1), (1, "you absolute moron", "c", 1), (1, "trash", "c", 1), (None, "trash idiot idiots", "c", 1), (None, None, None, None), (7, "", "c", 1), (8, long, "c", 1)], "doc_id long, text string, _score string, held_out int")
    for rows in (d, odd):
        got = Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.score(rows, model).collect())
        want = Counter((r["doc_id"], round(plain_score(model, r["text"]), 9), int(plain_score(model, r["text"]) >= 0.7)) for r in rows.collect())
        assert got == want


def test_fit_keeps_rows_of_one_id_apart(spark):
    rows = [(i // 2, ("women " if i % 2 else "") + ("bad rant" if i % 4 == 0 else "fine day")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 1) for i in range(200)], "doc_id long, toxic int, quality int")
    again = [toxicity.fit(d.repartition(n), lab) for n in (1, 5)]
    assert again[0] == again[1]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs(spark, ["a", None]), none).collect()
    assert len(got) == 2 and len({r["score"] for r in got}) == 1 and {r["predicted"] for r in got} == {0}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


def h64(parts):
    """Spark's xxhash64 of a string, or of longs one after the other."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    if isinstance(parts, str):
        return signed(xxhash.xxh64_intdigest(parts.encode(), seed=42))
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.to_bytes(8, "little", signed=True), seed=seed)
    return signed(seed)


def buckets(text):
    h = [h64(w) for w in WORD.findall(text or "")]
    return [x % quality.BUCKETS for x in h] + [h64([a, b]) % quality.BUCKETS for a, b in zip(h, h[1:])]


def plain_rules(text):
    text = text or ""
    w, lines = WORD.findall(text), text.split("\n")
    seen, repeated = set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_agrees_with_plain_python(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + [None, "", " \n\x0b", "a b c d e f g h " * 3, "x " * 40, "line one\nline one\n\n \nline one", "é# " * 30, "w" * 5000]
    good = [i for i in range(len(texts)) if i % 3 == 0]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, texts), spark.createDataFrame([(i,) for i in good + [0, None, 10**6]], "doc_id long")).collect()}
    raw, trusted = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t))
        if i in good:
            trusted.update(buckets(t))
    n, m = sum(raw.values()), sum(trusted.values())
    ratio = {b: math.log((trusted[b] + 1) / (m + quality.BUCKETS)) - math.log((raw[b] + 1) / (n + quality.BUCKETS)) for b in raw}
    for i, t in enumerate(texts):
        r, b = got[i], buckets(t)
        mean = sum(ratio[x] for x in b) / len(b) if b else 0.0
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(t)
        assert r["ratio"] == pytest.approx(mean, abs=1e-9) and r["kept"] == (not r["base_failed"] and r["ratio"] >= quality.THRESHOLD)
    assert quality.quality(docs(spark, []), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_quality_does_not_know_its_own_label(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + [None, "", "x " * 40]
    good = {i for i in range(len(texts)) if i % 3 == 0}
    judge = lambda ids: {r["doc_id"]: r for r in quality.quality_apart(docs(spark, texts), spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    got, counts = judge(sorted(good)), [Counter(buckets(t)) for t in texts]
    for i, own in enumerate(counts):
        raw, trusted = sum((c for j, c in enumerate(counts) if j != i), Counter()), sum((c for j, c in enumerate(counts) if j != i and j in good), Counter())
        p = trusted.total() / raw.total()
        mean = sum(n * math.log((trusted[b] + quality.PRIOR * p) / ((raw[b] + quality.PRIOR) * p)) for b, n in own.items()) / max(1, own.total())
        assert got[i]["ratio"] == pytest.approx(mean, abs=1e-9) and got[i]["kept"] == (not got[i]["base_failed"] and got[i]["ratio"] >= quality.THRESHOLD)
    # A row's own label moves its own ratio in neither direction.
    turned = judge(sorted(good ^ {3, 4}))
    assert turned[3]["ratio"] == pytest.approx(judge(sorted(good ^ {4}))[3]["ratio"], abs=1e-9)
    assert all(r["ratio"] == 0 for r in judge([]).values()) and all(r["ratio"] == 0 for r in judge([3]).values() if r["doc_id"] == 3)


def test_quality_query_treats_labelled_and_unlabelled_rows_alike(spark, sf_dir):
    from brindle.llm import queries

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op5_quality_rules(spark, sf_dir).collect() if not r["base_failed"]]
    rate = lambda rs: sum(r["kept"] for r in rs) / len(rs)
    assert rate([r for r in rows if labels.get(r["doc_id"]) == 1]) - rate([r for r in rows if r["doc_id"] not in labels]) < 0.25


def test_licences(spark):
    texts = [
        "CC BY cc by; ALL rights-reserved. all rights", None, "", "the GNU general public license general public license", "äcc by", "x Released under the MIT License. y",
        "Permission is hereby granted, FREE of charge, to some any person obtaining a copy of this software and documentation files", "Licensed under CC BY-NC 4.0.", "license " * 3000, "permission to use the software under the terms of a person",
    ]
    got = {r["doc_id"]: r for r in license_scan.report(license_scan.license_scan(docs(spark, texts))).collect()}
    low = {i: i + 32 for i in range(65, 91)}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        places = [(k, label) for k in range(len(w)) for p, label in license_scan.PHRASES if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None)) and 0 <= r["score"] <= 1
    assert got[5]["labels"] == "mit" and got[6]["labels"] == "mit" and got[7]["labels"] == "cc-by,cc-by-nc-4.0" and got[9]["labels"] == "" and got[8]["labels"] == ""
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def plain_matches(words, template, least=3):
    """(start, end, first, last) of all common runs of words that neither side extends."""
    out, n, m = [], len(words), len(template)
    for i in range(n):
        for j in range(m):
            if words[i] == template[j] and not (i and j and words[i - 1] == template[j - 1]):
                k = 0
                while i + k < n and j + k < m and words[i + k] == template[j + k]:
                    k += 1
                if k >= least:
                    out.append((i, i + k - 1, j, j + k - 1))
    return out


def plain_covered(matches, gap):
    """The most words of a template that a chain covers, by trying every chain."""
    best = 0

    def longer(chain, covered):
        nonlocal best
        best = max(best, covered)
        for m in matches:
            p = chain[-1]
            if m[1] > p[1] and m[3] > p[3] and m[0] - p[1] - 1 <= gap:
                longer([*chain, m], covered + min(m[1] - max(p[1], m[0] - 1), m[3] - max(p[3], m[2] - 1)))

    for m in matches:
        longer([m], m[1] - m[0] + 1)
    return best


def test_licence_matches_and_chains_agree_with_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        templates = [(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 14))), f"t{k}") for k in range(4)]
        scanner = license_scan.LicenseScanner((("a b", "p"),), templates, 3, 2, 0.8)
        words = []
        while len(words) < 30:
            t = rnd.choice(templates)[0].split()
            words += t[rnd.randint(0, 3) : rnd.randint(4, 14)] if rnd.random() < 0.6 else [rnd.choice("abcdefghxy") for _ in range(rnd.randint(1, 4))]
        raw = [w.encode() for w in words]
        _, found = scanner.matches(raw)
        plain = [(k, *m) for k, (t, _) in enumerate(templates) for m in plain_matches(words, t.split())]
        assert sorted((m.template - 1, m.start, m.end, m.first, m.at) for m in found) == sorted(plain)
        spans, best = scanner.spans(found)
        shares = [plain_covered([m[1:] for m in plain if m[0] == k], 2) / len(t.split()) for k, (t, _) in enumerate(templates)]
        assert best == pytest.approx(max(shares))
        assert {s.label for s in spans} == {label for (_, label), x in zip(templates, shares) if x >= 0.8}


def test_whole_licences_and_interrupted_ones(spark):
    mit, gpl = license_scan.WHOLE_TEXTS[0][0], license_scan.TEMPLATES[8][0]
    texts = [
        "Copyright (c) 2020 A. Person. " + mit, "GNU General Public License " + gpl, "a b c d e f q a b c q g h i", "x " * 50 + mit.replace("merge, publish", "combine, print") + mit,
        " ".join(mit.split()[:60]), mit * 200,
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    labels = {i: [s["label"] for s in r["spans"]] for i, r in got.items()}
    assert "mit" in labels[0] and any(s["label"] == "mit" and s["start"] == 5 and s["covered"] == 1 for s in got[0]["spans"])
    assert "gpl" in labels[1]
    scanner = license_scan.LicenseScanner((), (("a b c d e f a b c g h i", "t"),))
    spans, best = scanner.spans(scanner.matches(texts[2].encode().split())[1])
    assert [(s.start, s.end, s.covered) for s in spans] == [(0, 13, 1.0)] and best == 1
    whole = len(license_scan.words_of(mit))
    assert sum(s["end"] - s["start"] + 1 > 0.8 * whole for s in got[3]["spans"]) == 2
    assert not any(s["end"] - s["start"] + 1 > 0.5 * whole for s in got[4]["spans"])
    assert sum(s["end"] - s["start"] + 1 > 0.8 * whole for s in got[5]["spans"]) == 200


def test_base_columns_agree_with_sql(spark, sf_dir):
    """The columns of op5 and op6 that SQL can say."""
    import duckdb

    from brindle.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rules = con.execute(r"""SELECT doc_id, len(w), length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), len(regexp_extract_all(t, '[#*$%&|<>]')), len(l) - len(list_distinct(l)) FROM (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents)""").fetchall()
    got = queries.op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
    assert sorted(map(tuple, got)) == sorted(rules)
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS at, '{label}' AS label FROM w, unnest(range(1, len(words) + 1)) u(i) WHERE " + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in license_scan.PHRASES)
    base = con.execute(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents), p AS ({places})
        SELECT w.doc_id, len(words), count(p.at), min(p.at), max(p.at), coalesce(array_to_string(list_sort(list_distinct(list(p.label) FILTER (WHERE p.label IS NOT NULL))), ','), '') FROM w LEFT JOIN p ON p.doc_id = w.doc_id GROUP BY w.doc_id, words""").fetchall()
    got = queries.op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(base, key=repr)


def test_quality_of_odd_rows(spark):
    """Repeated rows, rows without an id, clashing columns."""
    rows = [(1, "a b c d e f g h " * 3, "c", 1), (1, "a b c d e f g h " * 3, "c", 1), (None, "x y z", "c", 1), (None, None, None, None), (None, "x y z", "c", 1), (2, "word " * 30_000, "c", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, bucket int")
    got = Counter((r["doc_id"], r["n_words"], r["base_failed"]) for r in quality.quality_apart(d, spark.createDataFrame([(1,), (None,)], "doc_id long")).collect())
    assert got == Counter([(1, 24, True), (1, 24, True), (None, 3, True), (None, 0, True), (None, 3, True), (2, 30_000, True)])


def test_licences_of_odd_rows(spark):
    rows = [(1, "CC BY", "clash", "x", 1), (1, "CC BY", "clash", "x", 1), (None, "all rights reserved", "clash", "x", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, labels string, spans string, score int")
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["labels"], r["score"]) for r in license_scan.report(license_scan.license_scan(d)).collect())
    assert got == Counter([(1, 2, 1, "cc-by", 1.0), (1, 2, 1, "cc-by", 1.0), (None, 3, 1, "reserved", 1.0), (None, 0, 0, "", 0.0)])


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, "u", None), (-2, None, ""), (-3, "u", "no tags &amp; here"), (-4, "u", "<html><body><nav><a href=x>menu</a></nav></body></html>"), (-5, "u", "<article><p>one &eacute;&nbsp; two<br>three <script>var a='</p>'</script><!-- no --><p a='>'>four</article><footer>x"), (-6, "u", "<p>" * 2000 + "<")]
    every = pages.union(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(every, html_extract.fit(every)).collect()}
    assert len(got) == every.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        expected = "\n\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == expected and got[r["page_id"]]["n_chars"] == len(expected)
    assert [got[i]["text"] for i in (-1, -2, -4)] == ["", "", ""] and got[-5]["text"] == "one é two three\n\nfour"
    assert html_extract.extract(every.limit(0), html_extract.Crf({}, [[0, 0], [0, 0]], [0, 0])).count() == 0


def test_model_tells_blocks_of_unseen_layouts(spark, sf_dir):
    htmls = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    half = len(htmls) // 2
    model = html_extract.train(*html_extract.training_pages(htmls[:half]))
    xs, ys = html_extract.training_pages(htmls[half:], layouts=4)
    wrong = sum(a != b for x, y in zip(xs, ys) for a, b in zip(model.viterbi(model.scores(x)), y))
    assert wrong / sum(map(len, ys)) < 0.01


def test_viterbi_is_the_best_of_all_labellings():
    rnd = random.Random(4)
    for _ in range(30):
        m = html_extract.Crf({c: rnd.uniform(-2, 2) for c in "abc"}, [[rnd.uniform(-1, 1) for _ in range(2)] for _ in range(2)], [rnd.uniform(-1, 1) for _ in range(2)])
        said = [(rnd.choice("abcd"), a, rnd.randint(a + 1, 5)) for a in (rnd.randint(0, 4) for _ in range(7))]
        page = html_extract.Page([html_extract.Block("x", (), 0)] * 5, said)
        total = lambda y: m.starts[y[0]] + sum(m.weights.get(f, 0) * sum(y[a:b]) for f, a, b in said) + sum(m.steps[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(5)] for k in range(32)), key=total)
        assert total(m.viterbi(m.scores(page))) == pytest.approx(total(best))


def test_training_is_the_gradient_of_the_likelihood(spark, sf_dir):
    """Chains longer than CHAIN are cut; on short pages the likelihood of the trained model, by all labellings, is at least that of nearby models."""
    htmls = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(6).collect()]
    xs, ys = html_extract.training_pages(htmls, layouts=1)
    pairs = [(x, y) for x, y in zip(xs, ys) if len(x.blocks) <= 12]
    assert pairs
    model = html_extract.train([x for x, _ in pairs], [y for _, y in pairs], l2=0.0)

    def likelihood(m):
        out = 0.0
        for x, y in pairs:
            e = m.scores(x)
            total = lambda z: m.starts[z[0]] + sum(s for s, v in zip(e, z) if v) + sum(m.steps[a][b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            out += total(y) - np.logaddexp.reduce([total([k >> i & 1 for i in range(len(e))]) for k in range(1 << len(e))])
        return out

    best, blank = likelihood(model), likelihood(html_extract.Crf({}, [[0, 0], [0, 0]], [0, 0]))
    assert best > blank / 5
    worst = max(model.weights, key=lambda f: model.weights[f])
    assert likelihood(html_extract.Crf({**model.weights, worst: -model.weights[worst]}, model.steps, model.starts)) < best


def test_labelled_pages_without_article(spark, sf_dir):
    known = json.loads((Path(__file__).parent / "labelled_pages.json").read_text())
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = spark.createDataFrame([(i, "u", p["html"]) for i, p in enumerate(known)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows, html_extract.fit(pages)).collect()}
    assert [got[i] for i in range(len(known))] == [p["text"] for p in known]


def test_repeated_rows_and_rows_without_ids(spark):
    """Pages and texts are read one by one: rows that repeat, and rows without an id, stay as they are."""
    page = "<html><body><article><p>One two three four five six.</p></article></body></html>"
    rows = [(1, "u", page, "clash", "x"), (1, "u", page, "clash", "x"), (None, None, page, "clash", "x"), (None, "v", None, None, None), (1, "w", "", "clash", "x")]
    model = html_extract.Crf({"in:article": 5.0, "in:p": -1.0}, [[0, 0], [0, 0]], [0, 0])
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string"), model).collect()
    said = "One two three four five six."
    assert Counter(map(tuple, got)) == Counter([(1, "u", said, len(said))] * 2 + [(None, None, said, len(said)), (None, "v", "", 0), (1, "w", "", 0)])
    texts = spark.createDataFrame([(1, "abc def", "c"), (1, "abc def", "c"), (None, "abc def", "c"), (None, None, "c"), (1, "", "c")], "doc_id long, text string, ids_sha256 string")
    sums = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(texts).collect())
    empty = hashlib.sha256(b"").hexdigest()
    (known,) = {k[1:] for k in sums if k[2] != empty}
    assert sums == Counter([(1, *known)] * 2 + [(None, *known), (None, 0, empty), (1, 0, empty)])


def test_blocks_of_odd_markup():
    blocks = lambda x: [b.text for b in html_extract.leaf_blocks(x)]
    assert blocks("<p>a<script src=/x/ >var a=1</script>b<style/>p{}</style >c") == ["abc"]
    assert blocks("<p>Euler: <math>x</math> ok <svg><path d='M'/><text>hi</text></svg> end</p><p>z") == ["Euler: x ok hi end", "z"]
    assert blocks("<svg>unclosed <p>still <b>here") == ["unclosed still here"] or blocks("<svg>unclosed <p>still <b>here") == ["unclosed", "still here"]
    assert blocks("<xmp>a &amp; <b></xmp>c<noscript>d</noscript><object>e</object>") == ["a &amp; <b>", "c", "d", "e"]
    assert blocks("a<!-->b<!-- x -- > y -->c<!--> d --!>e<!-- f") == ["abc d --!>e"]
    assert blocks("<p>x<script>never closed <p>y") == ["x"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == ["a", "b", "c", "d", "e", "f", "g"]


@pytest.mark.parametrize("piece", ["<div>t", "<div class='c{}'>t", "<i>t", "</b><i>t", "<p><div></section>t", "<li>t<ul>"])
def test_deep_pages_take_linear_time(piece):
    model, took = html_extract.Crf({"in:div": 1.0}, [[0, 0], [0, 0]], [0, 0]), {}
    for n in (5_000, 40_000):
        html_text = "".join(piece.replace("{}", "".join(chr(97 + k // 26**j % 26) for j in range(4))) for k in range(n))
        began = time.process_time()
        page = html_extract.read_page(html_text)
        model.viterbi(model.scores(page))
        took[n] = time.process_time() - began
    assert took[40_000] < 30 * took[5_000] + 1


def test_pipeline_stage_by_stage(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mix_sources", "bpe"]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    rows = [tuple(r) for r in base.collect()]
    rows += [(10_001, rows[0][1], "en", None, 1), (10_002, rows[1][1] + " extra", "en", "src1", 1), (10_003, None, None, None, None), (10_003, None, None, None, None), (10_004, "", "en", "src0", 0), (None, "words without an id", "en", "src2", 3)]
    now = spark.createDataFrame(rows, base.schema)
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        after_df = stage(spark, now, sf_dir)
        after = [tuple(r) for r in after_df.collect()]
        if name != "bpe":
            assert after_df.columns == corpus_pipeline.COLUMNS
            assert set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.fit(now, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            low = {r["doc_id"] for r in toxicity.score(now, model).filter("predicted = 0").collect()}
            assert sorted(after, key=repr) == sorted((r for r in before if r[0] in low), key=repr)
        if name == "exact_dedup":
            kept = {(i, s) for i, _, _, k, s in plain_dedup(before) if k}
            bare = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
            assert Counter((r[0], bare(r[1])) for r in after) == Counter(kept)
        if name == "ngram_join":
            # Texts without words stay; of each component the row of the smallest id, or one without an id where none of it has one.
            stay = {i for i, n, c in plain_components([r[:2] for r in before]) if i == c}
            assert sorted(after, key=repr) == sorted((r for r in before if r[0] in stay), key=repr)
        if name == "mix_sources":
            times = Counter({(r["doc_id"]): r["taken"] // r["size"] for r in mixing.mix(now).filter("taken > 0").collect()})
            assert Counter(r[0] for r in after) == times
        if name == "bpe":
            assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
        now = after_df if name == "bpe" else spark.createDataFrame(after, base.schema)


def test_pipeline_stages_of_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, key string, n int, text_hash string, _score string"
    same_row = (7, "one two three four five six", "en", "a", 27, "x", "k", 1, "h", "s")
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2
    rows = [same_row, same_row, (None, near, None, None, None, None, None, None, None, None), (None, near + " end", "en", "a", 3, "x", "k", 1, "h", "s"), (8, None, None, None, None, None, None, None, None, None), (8, "", "en", "b", 0, "x", "k", 1, "h", "s"), (9, near + " stop", "en", "b", 9, "x", "k", 1, "h", "s"), (10, near + " stop", "en", "b", 9, "x", "k", 1, "h", "s")]
    full, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        got = stage(spark, full, sf_dir)
        if name != "bpe":
            assert got.columns == corpus_pipeline.COLUMNS
        left = [tuple(r)[:2] for r in got.collect()]
        if name == "toxicity" or name == "bpe":
            assert len(left) == len(rows)
        if name == "exact_dedup":
            # Row 8 is null or empty: one of the two, which are equal texts.
            assert sorted((i for i, _ in left), key=repr) == sorted([7, 8, 9, None, None], key=repr)
        if name == "ngram_join":
            assert sorted((i for i, _ in left), key=repr) == sorted([7, 8, 8, 9], key=repr)


def test_pipeline_runs_whole(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
