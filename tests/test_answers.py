"""Answers of models: every place where one may be cut off, and fields of every type, against a plain walk."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from brindle.operators import answers, review

WHOLE = json.dumps(
    {
        "findings": [
            {"title": 'a}"]', "original": "o{[", "primaryOccurrence": {"file": "f", "startLine": "12", "endLine": None}, "suggestion": {"assumptions": ["p", 1, None, True], "requiredMigration": " CREATE INDEX x "}, "evidence": [{"kind": "schema", "startLine": 3}], "severity": "high"},
            {"title": "back\\slash", "original": "é 日本", "primaryOccurrence": {"startLine": True}, "otherOccurrences": [{"file": "g", "startLine": 1.5}, 7], "modelConfidence": "0.25", "kind": "behavioural", "severity": "fatal"},
            {"title": 5, "original": "x", "primaryOccurrence": {}},
            {"title": "t", "original": "x", "primaryOccurrence": 0},
            "no finding",
            {"title": "last", "original": "", "primaryOccurrence": [], "suggestion": {"requiredMigration": "omit"}, "evidence": "none", "modelConfidence": "high"},
        ],
        "declined": [{"siteId": "s1", "why": "w"}, {"siteId": ""}, {"siteId": "s1", "why": "again"}],
    },
    ensure_ascii=False,
)


def plain(raw):
    """(findings or None, repaired) by a walk over the characters."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", raw or "", re.S)
    text = (fence[1] if fence else raw or "").strip()
    if "{" not in text:
        return None, False
    text = text[text.index("{") :]
    stack, braces, quoted, skip, cut = [], 0, False, False, None
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
            braces += c == "{"
        elif not quoted and c in "}]":
            stack = stack[:-1]
            braces -= c == "}"
            if len(stack) == 2:
                cut = i + 1, "".join(reversed(stack))
            if c == "}" and braces == 0:
                text = text[: i + 1]
                break
    for body, repaired in ((text, False), (text[: cut[0]] + cut[1] if cut else "", True)):
        try:
            found = json.loads(body).get("findings")
            return (found if isinstance(found, list) else None), repaired
        except ValueError:
            pass
    return None, False


def titles(raw):
    found, repaired = plain(raw)
    return [(k, f["title"], f["original"], repaired) for k, f in enumerate(found or []) if isinstance(f, dict) and isinstance(f.get("title"), str) and isinstance(f.get("original"), str) and f.get("primaryOccurrence") not in (None, 0, "", False)]


def test_cut_at_every_place(spark):
    texts = [WHOLE[:n] for n in range(len(WHOLE) + 1)] + [f"Here is:\n```json\n{WHOLE}\n```\nand {{more}}", f"talk {WHOLE} trailing ]}}", f"```\n{WHOLE[:300]}", '{"a": "\\', '{"findings": [}', '{"findings": [{"title": "t", "original": "o", "primaryOccurrence": 1}, {"x": ]}', "}{", "{" * 200, '{"findings": {}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    got = {}
    for r in answers.findings(df).collect():
        got.setdefault(r["id"], []).append((r["at"], r["title"], r["original"], r["repaired"]))
    for i, x in enumerate(texts):
        assert sorted(got.get(i, [])) == titles(x), x
    failed = {r["id"] for r in answers.errors(df).collect()}
    assert failed == {i for i, x in enumerate(texts) if plain(x)[0] is None}


def test_fields_of_every_type(spark):
    rows = {r["at"]: r for r in answers.findings(spark.createDataFrame([(1, WHOLE)], "id int, raw string")).collect()}
    assert sorted(rows) == [0, 1, 5]
    a, b, c = rows[0], rows[1], rows[5]
    assert tuple(a["occurrence"]) == ("f", 12.0, 0.0, None, None, "") and a["assumptions"] == ["p", "1", "null", "true"] and a["migration"] == "CREATE INDEX x" and a["severity"] == "high"
    assert [tuple(e) for e in a["evidence"]] == [("schema", "", 3.0, 3.0, "", "")] and (a["confidence"], a["engine"], a["category"], a["access_style"]) == (0.5, "unknown", "other", "raw-sql")
    assert b["occurrence"]["start_line"] == b["occurrence"]["end_line"] == 1.0 and [o["start_line"] for o in b["others"]] == [1.5, 0.0] and (b["confidence"], b["kind"], b["severity"]) == (0.25, "behavioural", "medium")
    assert (c["migration"], c["evidence"], c["confidence"], c["occurrence"]["file"]) == (None, [], 0.5, "")


@pytest.mark.parametrize(
    "text,kept",
    [
        ("CREATE INDEX i ON t (a)", True), ("alter table t add column b int", True), ("ADD  CONSTRAINT c", True), ("add_index :t", True), ("create_index(:a)", True), ("addColumn x", True), ("createIndex", True), ("DROP INDEX i", True),
        ("omit", False), ("Omit.", False), ("none needed", False), ("No needed .", False), ("N/A", False), ("nil", False), ("---", False), ("..", False), ("not applicable", False), ("", False), (None, False), ("please add more memory", False), ("rename the variable", False), ("an index would help", False),
    ],
)
def test_migrations(spark, text, kept):
    row = spark.createDataFrame([(text,)], "m string").select(answers.migration(F.col("m")).alias("m")).first()
    assert row["m"] == (text if kept else None)


def test_declined_and_verdicts(spark):
    got = answers.declined(spark.createDataFrame([(1, WHOLE), (2, None)], "id int, raw string")).collect()
    assert [tuple(r) for r in got] == [(1, "s1", "w")]
    raw = json.dumps({"verdicts": [{"id": "a", "verdict": "problem", "category": "n-plus-one", "why": "loop"}, {"id": "a", "verdict": "clean"}, {"id": 7, "verdict": "unsure"}, {"id": "c", "verdict": 1}, {"verdict": "problem"}, None, "x"]})
    got = answers.verdicts(spark.createDataFrame([(1, raw), (2, '{"verdicts": 1}')], "id int, raw string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "a", "problem", "n-plus-one", "loop"), (1, 2, "7", "unsure", "other", ""), (1, 3, "c", "clean", "other", "")]


def test_flat_answers_take_no_number_for_a_title(spark):
    raw = '{"findings": [{"title": 5, "original": "o", "path": "p"}, {"title": "t", "original": "o", "path": "p", "line": "12"}]}'
    got = review.answers(spark.createDataFrame([(1, raw)], "id int, raw string")).collect()
    assert [(r["title"], r["line"]) for r in got] == [(None, None), ("t", 12)]
    assert [r["title"] for r in review.plausible(review.answers(spark.createDataFrame([(1, raw)], "id int, raw string"))).collect()] == ["t"]


def test_nothing(spark):
    empty = spark.createDataFrame([], "id int, raw string")
    assert [f(empty).count() for f in (answers.findings, answers.errors, answers.declined, answers.verdicts, answers.flat)] == [0] * 5


def test_a_text_is_walked_once(spark):
    rows = spark.createDataFrame([(1, '{"findings": [{"a": "x"}, {"b": "tail { [ } ]')], "id int, raw string")
    plan = answers.errors(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("regexp_extract_all(") == 1


def test_brackets_of_an_unfinished_string_and_long_lists(spark):
    long = '{"findings": [' + ", ".join(f'"s{k} \\" }}"' for k in range(30_000)) + "]}"
    rows = [(1, '{"findings": [{"a": "x"}, {"b": "tail { [ } ]'), (2, long), (3, '{"findings": [{"a": "} ]"}]} and {"more": 1}'), (4, '{"findings": ["a", {"b": "x\\'), (5, '{"a": "\\"}')]
    got = {r.id: (r.n, r.repaired, r.error) for r in answers.listed(spark.createDataFrame(rows, "id int, raw string"), "findings").selectExpr("id", "size(items) AS n", "repaired", "error").collect()}
    assert got[1] == (1, True, None) and got[2] == (30_000, False, None) and got[3] == (1, False, None)
    assert got[4][1:] == (False, "not-json") and got[5][1:] == (False, "not-json")
