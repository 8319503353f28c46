"""Findings checked against the files they cite, what a proposal is known to change, and the tests of the gate, computed from texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brindle.functions.calls import call_deltas, query_dsl, with_call_shapes
from brindle.functions.engines import family_of
from brindle.functions.hot import hot_keys, join_hot
from brindle.functions.paths import path_kinds, trigger_of
from brindle.functions.statements import collapsed, equivalence, with_sql_shapes
from brindle.functions.text import contains_loosely, first_significant_line, missing_dimensions, slice_lines
from brindle.operators import answers as read
from brindle.operators import ddl, detect, gate
from brindle.session import cut

#: Lines around a citation in which its excerpt may stand.
DRIFT = 5
# Wordings of index definitions, and categories whose gain only data can tell.
NAMES_INDEX = r"(?i)\b(?:CREATE\s+(?:UNIQUE\s+)?INDEX|USING\s+btree|@@index)\b"
INDEX_DDL = r"(?i)\b(?:CREATE\s+(?:UNIQUE\s+)?INDEX|DROP\s+INDEX|ADD\s+INDEX|add_index|createIndex|@@index)\b"
SCHEMA_EVIDENCE = ("index-definition", "schema", "migration")
SCHEMA_CATEGORIES = ("missing-index", "redundant-index")
DATA_DEPENDENT = ("missing-index", "full-scan", "inefficient-join", "implicit-cast", "sort-in-memory")
# How an assumption says that a name is not used, and words that are no names there.
UNUSED = r"(?i)\b([A-Za-z_]\w{2,})\b[^.]{0,60}?(?:is\s+not\s+used|isn't\s+used|unused|no\s+longer\s+used|only\s+used\s+(?:for|to|in))"
NO_NAMES = ("the", "this", "that", "value", "result", "variable", "field", "column", "query", "row", "data")
# Members that code may reach for though no file has them, and how many files and characters make a vocabulary.
UNIVERSAL = (
    "append extend items keys values strip split join format lower upper replace setdefault update sort reverse copy annotate aggregate filter exclude exists count first last distinct order_by values_list select_related "
    "prefetch_related bulk_create bulk_update get_or_create update_or_create in_bulk iterator only defer none union push map reduce concat includes length then catch toString valueOf"
).split()
ATTRIBUTE = r"(?:\b([A-Za-z_]\w*)\s*)?\.\s*([A-Za-z_][A-Za-z0-9_]{3,})\b"
LEAST_FILES, LEAST_CHARS = 25, 20_000
#: Brackets that nest deeper are compared as they are.
INERT_ROUNDS = 6


def scoped(rows: DataFrame) -> DataFrame:
    """rows (path, content, line, ...) with loop_depth, opens_loop, symbol and trigger of the line, read from the content and never from what a finding says.

    Rows of one file that follow each other share one reading. Without a content, or a line in it, all are null."""
    schema = rows.select("*", F.lit(0).alias("loop_depth"), F.lit(True).alias("opens_loop"), F.lit("").alias("symbol"), F.lit(True).alias("_decorated")).schema
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told: list[tuple] = []
            paths, texts, lines = (b.column(names.index(c)).to_pylist() for c in ("path", "content", "line"))
            k = 0
            while k < len(paths):
                end = k
                while end < len(paths) and paths[end] == paths[k] and texts[end] == texts[k]:
                    end += 1
                text = texts[k]
                wanted = {n - 1 for n in lines[k:end] if n is not None and n > 0} if text is not None else set()
                around = detect.scopes(paths[k], text, wanted) if wanted else {}
                own = text.split("\n") if wanted else []
                for n in lines[k:end]:
                    s = around.get(n - 1) if n is not None else None
                    told.append((None, None, None, None) if s is None else (len(s.headers), s.opens, s.symbol, bool(detect.DECORATOR.search("\n".join(detect._above(own, n - 1, s))))))
                k = end
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([t[c] for t in told], kind) for c, kind in enumerate(kinds)]], [*names, "loop_depth", "opens_loop", "symbol", "_decorated"])

    read = rows.mapInArrow(run, schema)
    return read.withColumn("trigger", F.when(F.col("_decorated").isNotNull(), trigger_of(path_kinds(F.col("path")), F.col("symbol"), F.col("_decorated")))).drop("_decorated")


def _notes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for t, n in pairs]), lambda x: x.isNotNull())


def checked_evidence(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(id, held, missing_file, missing_quote): of each finding with evidence (array of file, quote, kind) what is held up by the files (path, content), and whether a cited file or quote is not there."""
    cited = findings.select("id", F.posexplode("evidence").alias("at", "e")).select("id", "at", F.col("e.file").alias("path"), F.col("e.quote").alias("quote"), F.col("e.kind").alias("kind"))
    many = hot_keys(cited.groupBy("path").agg(F.count("*").alias("n")), ["path"])
    joined = join_hot(cited, files.select("path", "content"), ["path"], many, ["id", "at"], "left")
    there = F.col("content").isNotNull()
    quoted = there & ((F.trim(F.coalesce("quote", F.lit(""))) == "") | contains_loosely(F.col("content"), F.col("quote")))
    told = joined.select("id", "at", "path", "quote", "kind", there.alias("there"), quoted.alias("quoted"))
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("quoted"), F.struct("at", F.col("path").alias("file"), "quote", "kind")))), lambda e: F.struct(e["file"].alias("file"), e["quote"].alias("quote"), e["kind"].alias("kind")))
    return told.groupBy("id").agg(held.alias("held"), F.bool_or(~F.col("there")).alias("missing_file"), F.bool_or(F.col("there") & ~F.col("quoted")).alias("missing_quote"))


def grounded(findings: DataFrame, files: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Findings with what the files say of them.

    findings: id, path, line, end_line, excerpt, original, proposed, kind, category, argument, rationale, migration, evidence. files: path,
    content. advice: (id, duplicate_of, covered_by) of ddl.index_advice for findings that propose an index.
    Adds grounding (rejected: the cited file, or one of the evidence, is not there; needs-verification: a citation does not hold;
    verified), citations and analysis (the notes of both kinds), the evidence that holds, the kind (behavioural where the output demonstrably
    changes), the equivalence, and the scope of the cited line.
    """
    return _grounded(findings, files, advice).drop(*_SHAPES)


#: Statements and calls of both sides, read once.
_SHAPES = ("_a", "_b", "_oa", "_ob")


def _grounded(findings: DataFrame, files: DataFrame, advice: DataFrame | None) -> DataFrame:
    """grounded, with the shapes of both sides."""
    many = hot_keys(findings.groupBy("path").agg(F.count("*").alias("n")), ["path"])
    cited = join_hot(findings, files.select("path", "content"), ["path"], many, ["id"], "left")
    held = checked_evidence(findings, files)
    rows = scoped(cited).join(held.hint("merge"), "id", "left")
    rows = with_sql_shapes(rows, _a=F.col("original"), _b=F.col("proposed"))
    rows = with_call_shapes(rows, F.coalesce("loop_depth", F.lit(0)), _oa=F.col("original"), _ob=F.col("proposed"))
    rows = rows.withColumn("equivalence", equivalence(F.col("_a"), F.col("_b"), call_deltas(F.col("_oa"), F.col("_ob"))))
    if advice is not None:
        rows = rows.join(advice.select("id", "duplicate_of", "covered_by").hint("merge"), "id", "left")
    else:
        rows = rows.select("*", F.lit(None).alias("duplicate_of"), F.lit(None).alias("covered_by"))
    there = F.col("content").isNotNull()
    lines = F.size(F.split("content", "\n", -1))
    outside = there & ((F.col("line") < 1) | (F.col("line") > lines))
    around = slice_lines(F.col("content"), F.col("line") - DRIFT, F.col("end_line") + DRIFT)
    moved = there & ~outside & (F.trim("excerpt") != "") & ~F.coalesce(contains_loosely(around, first_significant_line(F.col("excerpt"))), F.lit(False))
    absent = there & (F.trim("original") != "") & ~contains_loosely(F.col("content"), F.col("original"))
    citations = _notes((outside, "line-outside-file"), (moved, "excerpt-not-there"), (absent, "original-not-there"), (F.col("missing_quote"), "quote-not-there"), (F.col("missing_file"), "evidence-file-missing"))
    claims = F.col("kind") == "equivalent"
    e = F.col("equivalence")
    named = F.concat_ws("", "proposed", "rationale").rlike(NAMES_INDEX)
    backed = F.exists(F.coalesce("held", F.array().cast("array<struct<file:string,quote:string,kind:string>>")), lambda x: x["kind"].isin(*SCHEMA_EVIDENCE))
    analysis = _notes(
        (claims & (F.size(e["hard"]) > 0), "reclassified"),
        (claims & (F.size(e["hard"]) == 0) & (F.size(e["soft"]) > 0), "needs-review"),
        (claims & (F.size(e["undecided"]) > 0), "not-machine-checkable"),
        (claims & (F.size(missing_dimensions(F.coalesce("argument", F.lit("")))) > 0), "argument-incomplete"),
        (named & ~backed & (F.coalesce("migration", F.lit("")) == ""), "index-without-evidence"),
        (F.col("duplicate_of").isNotNull(), "redundant-index"),
        (F.col("duplicate_of").isNull() & F.col("covered_by").isNotNull(), "covered-index"),
        ((F.col("category") == "n-plus-one") & (F.col("loop_depth") == 0), "not-in-a-loop"),
        (F.col("trigger").isin("migration", "test"), "cold-path"),
    )
    fatal = ~there | F.coalesce("missing_file", F.lit(False))
    out = rows.select("*", citations.alias("citations"), analysis.alias("analysis"), fatal.alias("_fatal"))
    status = F.when(F.col("_fatal"), "rejected").when(F.size("citations") == 0, "verified").otherwise("needs-verification")
    kind = F.when(claims & (F.size(e["hard"]) > 0), "behavioural").otherwise(F.col("kind"))
    return out.withColumns({"grounding": status, "kind": kind}).drop("_fatal", "evidence", "missing_file", "missing_quote").withColumnRenamed("held", "evidence")


def reviewed(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with everything that files say of them, in one plan: the columns of grounded, where the indexes that a finding proposes are held against those that the files
    declare, and those of with_facts (counted, unmeasured, steps, questionable). Statements and calls are read once. findings also has an engine.
    """
    proposed = ddl.proposed_indexes(findings.select("id", F.concat_ws("\n", "migration", "proposed").alias("text")))
    rows = _grounded(findings, files, ddl.index_advice(proposed, cut(ddl.index_facts(files), "indexes")))
    return _counted(rows, [c for c in rows.columns if c not in _SHAPES])


def with_facts(rows: DataFrame, loop_depth: Column) -> DataFrame:
    """rows (engine, category, original, proposed, migration) with counted, unmeasured, steps and questionable.

    counted: what two statements, or the calls of two snippets, say of a change; unmeasured: what only a database can; steps: the instruments that
    settle it, in order; questionable: nothing is counted, and the gain depends on data.
    """
    told = with_sql_shapes(rows, _a=F.col("original"), _b=F.col("proposed"))
    return _counted(with_call_shapes(told, loop_depth, _oa=F.col("original"), _ob=F.col("proposed")), rows.columns)


def _counted(told: DataFrame, columns: list[str]) -> DataFrame:
    """with_facts of rows that have the shapes of both sides."""
    a, b, x, y = F.col("_a"), F.col("_b"), F.col("_oa"), F.col("_ob")
    sql = lambda s: s["kind"].isNotNull() & (s["kind"] != "other")
    both = (a["kind"] == "select") & (b["kind"] == "select")
    star = lambda s: F.coalesce(F.get(s["projection"], F.lit(0)) == "*", F.lit(False))
    n = lambda c: c.cast("string")
    fewer = F.size(a["projection"]) - F.size(b["projection"])
    calls = ~(sql(a) & sql(b)) & x.isNotNull() & y.isNotNull()
    ends = lambda s, *names: F.exists(s["terminals"], lambda t: F.lit(False) if not names else _any([t.startswith(v) for v in names]))
    lost = F.size(x["projection"]) - F.size(y["projection"])
    facts = [
        (both & star(a) & ~star(b), F.concat(n(F.size(b["projection"])), F.lit(" named columns instead of every column"))),
        (both & ~star(a) & ~star(b) & (fewer > 0), F.concat(n(fewer), F.lit(" fewer column(s)"))),
        (both & (a["limit"] == "") & (b["limit"] != ""), F.concat(F.lit("Caps the result at "), b["limit"], F.lit(" row(s), unbounded before"))),
        ((a["kind"] == "ddl-index") & (b["kind"] == "ddl-index"), F.lit("Changes an index definition, which every write pays for")),
        (calls & (y["trips"] == 0) & (x["trips"] > 0), F.concat(F.lit("No database call within the code shown, "), n(x["trips"]), F.lit(" before; moved or gone is not decidable"))),
        (calls & (y["trips"] > 0) & (y["trips"] < x["trips"]), F.concat(n(y["trips"]), F.lit(" database call(s), "), n(x["trips"]), F.lit(" before"))),
        (calls & x["per_iteration"] & ~y["per_iteration"], F.lit("Moves the query out of the loop")),
        (calls & x["per_iteration"] & y["batched"] & ~x["batched"], F.lit("One set-membership predicate instead of a per-row lookup")),
        (calls & x["projection"].isNull() & (F.size(y["projection"]) > 0), F.concat(n(F.size(y["projection"])), F.lit(" named column(s) instead of whole instances"))),
        (calls & x["projection"].isNotNull() & y["projection"].isNotNull() & (lost > 0), F.concat(n(lost), F.lit(" fewer column(s) fetched"))),
        (calls & F.coalesce(x["row_limit"], F.lit(0)).eqNullSafe(0) & (y["row_limit"] > 0), F.concat(F.lit("Caps the result at "), n(y["row_limit"]), F.lit(" row(s) of the calls, unbounded before"))),
        (calls & ends(x, "count") & ends(y, "exists", "any"), F.lit("Stops at the first row instead of counting all")),
        (calls & (F.size(x["order_by"]) > 0) & (F.size(y["order_by"]) == 0) & (F.size(y["aggregates"]) > 0), F.concat(F.lit("One "), F.array_join(y["aggregates"], "/"), F.lit(" aggregate instead of an ordered fetch"))),
        (calls & ~x["materialised"] & y["materialised"] & (y["trips"] <= x["trips"]), F.lit("Evaluates once and uses the result again")),
        (calls & (x["fetch_mode"] == "eager") & (y["fetch_mode"] == "lazy"), F.lit("Declares the association lazy")),
        (calls & (x["fetch_mode"] == "lazy") & (y["fetch_mode"] == "eager"), F.lit("Declares the association eager")),
        (calls & (F.size(x["eager"]) == 0) & (F.size(y["eager"]) > 0), F.concat(F.lit("Adds eager loading ("), F.array_join(y["eager"], ", "), F.lit(")"))),
    ]
    counted = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), v) for t, v in facts]), lambda v: v.isNotNull())
    depends = F.col("category").isin(*DATA_DEPENDENT)
    index = (F.col("category") == "missing-index") | (F.coalesce("migration", F.lit("")) != "")
    unmeasured = _notes(
        (calls & (x["fetch_mode"] == "eager") & (y["fetch_mode"] == "lazy"), "callers-touch-collection"),
        (calls & (x["fetch_mode"] == "lazy") & (y["fetch_mode"] == "eager"), "readers-need-collection"),
        (calls & x["per_iteration"], "trip-count"),
        (F.lit(True), "speed"),
        (depends, "planner-choice"),
        (index, "existing-index"),
        (index, "write-cost"),
        (family_of(F.col("engine")) == "vector", "recall"),
        (family_of(F.col("engine")) == "warehouse", "bytes-scanned"),
    )
    told = told.select("*", counted.alias("counted"), unmeasured.alias("unmeasured"))
    claim = F.col("category").isin(*CLAIM_INSTRUMENTS)
    instead = F.col("category").isin(*REPLACES_PLAN)
    steps = _notes(
        (claim, "claim"),
        (~(claim & instead) & sql(a), "plan"),
        (~(claim & instead) & ~sql(a) & (x.isNotNull() | y.isNotNull()), "count-queries"),
        (~(claim & instead) & ~sql(a) & x.isNull() & y.isNull(), "engine-recipe"),
        (sql(a) | (x.isNull() & y.isNull()), "statistics"),
    )
    return told.select(*columns, "counted", "unmeasured", steps.alias("steps"), ((F.size("counted") == 0) & depends).alias("questionable"))


# Categories that an instrument of their own measures, and those of them that a plan can't speak to.
CLAIM_INSTRUMENTS = ("plan-cache-miss", "connection-handling", "transaction-scope", "redundant-index", "round-trip", "n-plus-one", "batching")
REPLACES_PLAN = ("connection-handling", "transaction-scope", "redundant-index", "round-trip", "n-plus-one", "batching")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def without_inert(code: Column) -> Column:
    """Code without what changes no statement: column choices before a call that reads no column, doubled brackets, brackets around a whole condition, a colon at the end."""
    out = collapsed(code)
    for _ in range(INERT_ROUNDS):
        out = F.regexp_replace(out, r"\.\s*(?:only|defer)\s*\([^()]*\)\s*(?=\.\s*(?:exists|count)\s*\()", "")
    nested = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*"
    for _ in range(INERT_ROUNDS):
        out = F.regexp_replace(out, rf"\(\s*(\({nested}\))\s*\)", "$1")
    for _ in range(INERT_ROUNDS):
        out = F.regexp_replace(out, rf"\b(if|elif|while|return|assert|not)\s*\(\s*({nested})\s*\)\s*(:?)\s*$", "$1 $2$3")
    out = F.regexp_replace(out, r"\b(if|elif|while|return|assert)\s+", "$1 ")
    return collapsed(F.regexp_replace(out, r"\s*:\s*$", ""))


def invented_names(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name): the first attribute of each proposal (id, proposed) that no file (path, content) has.

    Nothing is invented as long as the files are too few, or too small, to be a vocabulary. A constant of a known name is excused. The
    words of all files and the names are joined by equality; a name's row count is that of the proposals.
    """
    size = files.agg(F.count("*").alias("_files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("_chars"))
    words = files.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("word")).distinct()
    every = lambda g: F.regexp_extract_all("proposed", F.lit(ATTRIBUTE), F.lit(g))
    used = proposals.select("id", F.posexplode(F.arrays_zip(every(1).alias("receiver"), every(2).alias("name"))).alias("at", "m")).select("id", "at", "m.receiver", "m.name").filter(~F.col("name").isin(*UNIVERSAL))
    many = lambda c: hot_keys(used.groupBy(c).agg(F.count("*").alias("n")), [c])
    told = join_hot(used, words.select(F.col("word").alias("name"), F.lit(True).alias("_known")), ["name"], many("name"), ["id"], "left")
    told = join_hot(told, words.select(F.col("word").alias("receiver"), F.lit(True).alias("_of_known")), ["receiver"], many("receiver"), ["id"], "left")
    constant = F.col("name").rlike(r"^[A-Z][A-Z0-9_]*$") & F.coalesce("_of_known", F.lit(False))
    gone = told.filter(F.col("_known").isNull() & ~constant)
    # One row: the size of the corpus.
    enough = gone.join(F.broadcast(size), F.lit(True)).filter((F.col("_files") >= LEAST_FILES) & (F.col("_chars") >= LEAST_CHARS))
    return enough.groupBy("id").agg(F.min_by("name", "at").alias("name"))


def contradicted(rows: DataFrame) -> Column:
    """Whether an assumption of a finding (assumptions, content, end_line) says that a name is unused which stands in the lines after it, comments left out."""
    after = F.split("content", "\n", -1)
    rest = F.transform(F.slice(after, F.col("end_line") + 1, F.greatest(F.size(after) - F.col("end_line"), F.lit(0))), lambda x: F.regexp_replace(x, r"(?:#|//).*$", ""))
    names = F.filter(F.transform("assumptions", lambda s: F.regexp_extract(s, UNUSED, 1)), lambda w: (w != "") & ~F.lower(w).isin(*NO_NAMES))
    words = F.regexp_extract_all(F.array_join(rest, "\n"), F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    return F.coalesce(F.arrays_overlap(names, words), F.lit(False)) & (F.size(names) > 0)


def with_reasons(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Grounded findings with counted facts, and the reason for which each is held back (null if it is published) and its severity.

    rows: the columns of grounded and with_facts, assumptions, samples and flagged. Every test of the gate is computed here from the texts.
    """
    base = with_sql_shapes(rows, _a=F.col("original"), _b=F.col("proposed"))
    base = with_call_shapes(base, F.coalesce("loop_depth", F.lit(0)), _oa=F.col("original"), _ob=F.col("proposed"))
    invented = invented_names(rows.select("id", "proposed"), files).select("id", F.lit(True).alias("_invented"))
    base = base.join(invented.hint("merge"), "id", "left")
    sql = lambda s: s["kind"].isNotNull() & (s["kind"] != "other")
    data_access = sql(F.col("_a")) | sql(F.col("_b")) | F.col("_oa").isNotNull() | F.col("_ob").isNotNull() | query_dsl(F.col("original")).isNotNull() | query_dsl(F.col("proposed")).isNotNull()
    both = F.col("_oa").isNotNull() & F.col("_ob").isNotNull()
    f = {
        "original": without_inert(F.col("original")),
        "proposed": F.when(F.trim("proposed") == "", "").otherwise(without_inert(F.col("proposed"))),
        "invented": F.coalesce("_invented", F.lit(False)),
        "data_access": data_access,
        "category": F.col("category"),
        "count_a": F.when(both, F.col("_oa.trips")),
        "count_b": F.when(both, F.col("_ob.trips")),
        "leaves_loop": F.coalesce(F.col("_oa.per_iteration") & ~F.col("_ob.per_iteration"), F.lit(False)),
        "contradicted": contradicted(base),
        "trigger": F.col("trigger"),
        "kind": F.col("kind"),
        "schema_object": F.col("category").isin(*SCHEMA_CATEGORIES) & F.concat_ws(" ", "original", "proposed", "migration").rlike(INDEX_DDL),
        "questionable": F.col("questionable"),
        "counted": F.col("counted"),
        "samples": F.col("samples"),
        "flagged": F.col("flagged"),
        "per_iteration": (F.coalesce("loop_depth", F.lit(0)) > 0) | F.coalesce("opens_loop", F.lit(False)),
    }
    told = base.select(*rows.columns, *[c.alias(f"_{n}") for n, c in f.items()])
    f = {n: F.col(f"_{n}") for n in f} | {"counted_n": F.size("counted")}
    reason = gate.suppression(f)
    level = gate.capped(gate.severity(f), F.col("grounding") == "needs-verification", f["samples"], f["flagged"], f["counted_n"])
    judged = told.select(*rows.columns, reason.alias("reason"), level.alias("severity"))
    # What is held back for where it runs, or for how little it saves, informs.
    return judged.withColumn("severity", F.when(F.col("reason").isin("cold-path", "immaterial"), "info").otherwise(F.col("severity")))


# Ranks in a report.
KIND_RANK, GROUNDING_RANK = ("equivalent", "behavioural"), ("verified", "needs-verification", "rejected")


def report_order() -> list[Column]:
    """Same output first, then by severity, then by how sure the citation is."""
    rank = lambda c, names: F.coalesce(*[F.when(F.col(c) == n, F.lit(k)) for k, n in enumerate(names)], F.lit(len(names)))
    return [rank("kind", KIND_RANK), rank("severity", gate.SEVERITIES), rank("grounding", GROUNDING_RANK)]


def plausible(answers: DataFrame) -> DataFrame:
    """Of parsed answers (title, original, path, migration, ...) those with a title, a quoted original and a place; a migration that only echoes a placeholder, or defines nothing, is null."""
    return answers.filter(F.col("title").isNotNull() & F.col("original").isNotNull() & F.col("path").isNotNull()).withColumn("migration", read.migration(F.col("migration")))


def answers(responses: DataFrame) -> DataFrame:
    """(id, at, title, original, path, line, proposed, migration, repaired) of model responses (id, raw) whose findings are flat: the first object counts, and a
    list that was cut off ends after its last whole element. Titles, originals and paths are texts or null; a line may be a number in quotes."""
    return read.flat(responses)
