"""Answers of models read as tables: fences and talk around them, lists that were cut off, and fields of the wrong type.

A text is split at its brackets, and one fold over these pieces knows the open brackets at every place: where the first object ends
and, for a text that was cut off, where its last whole element does and what has to be closed after it. Fields are read one by one from a variant, so that a
wrong type costs a field, not the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bracket with what stands before it: strings (a last one may lack its end) and stretches without either; a backslash takes the next character with it
# everywhere. A piece begins where the one before it ends, never in the middle of a string.
_PIECE = r'(?s)\G(?:"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?+\z)|[^"{}\[\]\\]++|\\.)*+[{}\[\]]'
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_FENCE = r"(?s)```(?:json)?\s*(.*?)```"
# Severities, what stands for no migration, and the words that define something.
SEVERITIES = ("critical", "high", "medium", "low", "info")
PLACEHOLDER = r"(?i)^\s*(?:omit|none|n\/?a|null|nil|-+|\.{2,}|no(?:ne)? needed|not applicable)\s*\.?\s*$"
DDL_VERB = r"(?i)\b(?:CREATE|ALTER|DROP|ADD\s+(?:INDEX|COLUMN|CONSTRAINT)|add_index|create_index|createIndex|addColumn)\b"


def _walked(text: Column) -> Column:
    """struct(end, cut, closers) of a text that begins with a brace: the place after the brace that closes it, the place after the last element that is
    whole in the list at depth two, and what closes the brackets that are open there; each null where there is none."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("braces"), F.lit("").alias("open"), none.alias("end"), none.alias("cut"), F.lit("").alias("closers"))

    def step(s: Column, piece: Column) -> Column:
        after = s["pos"] + F.length(piece)
        brace, bracket = piece.endswith("{"), piece.endswith("[")
        closes, closed = ~(brace | bracket), piece.endswith("}")
        braces = s["braces"] + F.when(brace, 1).when(closed, -1).otherwise(0)
        open_ = F.when(brace, F.concat(F.lit("}"), s["open"])).when(bracket, F.concat(F.lit("]"), s["open"])).otherwise(F.substring(s["open"], 2, 1 << 30))
        whole = closes & (F.length(open_) == 2)
        now = F.struct(
            after.alias("pos"), braces.alias("braces"), open_.alias("open"), F.when(closed & (braces == 0), after).alias("end"),
            F.when(whole, after).otherwise(s["cut"]).alias("cut"), F.when(whole, open_).otherwise(s["closers"]).alias("closers"),
        )
        return F.when(s["end"].isNotNull(), s).otherwise(now)

    return F.aggregate(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), start, step)


def documents(responses: DataFrame) -> DataFrame:
    """(id, document, repaired, error) of every response (id, raw): its first object as a variant, whether it had to be repaired, or why there is none:
    empty, no-object or not-json. A key that an object repeats makes it no JSON."""
    fenced = F.regexp_extract("raw", _FENCE, 1)
    text = F.trim(F.when(F.col("raw").rlike(_FENCE), fenced).otherwise(F.coalesce("raw", F.lit(""))), F.lit(" \t\r\n\x0b\x0c"))
    # Each step is read by several others: as the only element of an array that is exploded it is made once, and no filter is put before it.
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    rows = once(responses.select("id", "raw"), "_text", text).drop("raw")
    rows = once(rows, "_from", F.regexp_extract("_text", r"(?s)\{.*+", 0))
    rows = once(rows, "_w", _walked(F.col("_from")))
    # A text whose first object does not end is no JSON.
    rows = once(rows, "_whole", F.try_parse_json(F.when(F.col("_w.end").isNotNull(), F.substring("_from", F.lit(1), F.col("_w.end")))))
    mended = F.try_parse_json(F.when(F.col("_w.cut").isNotNull(), F.concat(F.substring("_from", F.lit(1), F.col("_w.cut")), F.col("_w.closers"))))
    rows = once(rows, "_mended", F.when(F.col("_whole").isNull(), mended))
    error = F.when(F.col("_text") == "", "empty").when(F.col("_from") == "", "no-object").when(F.col("_whole").isNull() & F.col("_mended").isNull(), "not-json")
    return rows.select("id", F.coalesce("_whole", "_mended").alias("document"), (F.col("_whole").isNull() & F.col("_mended").isNotNull()).alias("repaired"), error.alias("error"))


def listed(responses: DataFrame, name: str) -> DataFrame:
    """(id, items, repaired, error): the list of this name in each response, an array of variants; error is also no-list."""
    items = _let(F.try_variant_get("document", f"$.{name}", "variant"), lambda v: F.when(kind_of(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")))
    read = documents(responses).select("id", F.explode(F.array(items)).alias("items"), "repaired", "error")
    return read.select("id", "items", "repaired", F.coalesce("error", F.when(F.col("items").isNull(), "no-list")).alias("error"))


def errors(responses: DataFrame, name: str = "findings") -> DataFrame:
    """(id, error) of the responses that give no list."""
    return listed(responses, name).filter("error IS NOT NULL").select("id", "error")


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _fields(value: Column, names: str) -> Column:
    """The named fields of an object, each a variant; all null if it is no object."""
    return F.try_variant_get(value, "$", "struct<" + ",".join(f"{n}:variant" for n in names.split()) + ">")


def kind_of(value: Column) -> Column:
    """STRING, BOOLEAN, VOID (null), OBJECT, ARRAY or a kind of number; null for a missing field."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def text(value: Column, default: str | None = "") -> Column:
    """A field as text, whatever its type; default if it is missing or null."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(default).cast("string"))


def strict(value: Column) -> Column:
    """A field if it is a text, else null."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column, default: Column | float | None) -> Column:
    """A field as a number: texts are read, true and false count 1 and 0, null and blank 0; default if it is missing or none."""
    default = default if isinstance(default, Column) else F.lit(default).cast("double")
    told = lambda s: F.when(s == "", 0.0).when(s.rlike(_NUMBER), s.try_cast("double")).when(s.isin("true", "false") & (kind_of(value) == "BOOLEAN"), (s == "true").cast("double"))
    return F.coalesce(F.when(F.is_variant_null(value), 0.0), _let(F.trim(F.try_variant_get(value, "$", "string")), told), default)


def filled(value: Column) -> Column:
    """Whether a field is there and says something: no null, false, zero or empty text."""
    said = lambda s: (s != "") & ~((s == "false") & (kind_of(value) == "BOOLEAN")) & ~(s.rlike(_NUMBER) & (kind_of(value) != "STRING") & (F.coalesce(s.try_cast("double"), F.lit(1.0)) == 0))
    return F.coalesce(_let(F.try_variant_get(value, "$", "string"), said), F.lit(False))


def migration(text: Column) -> Column:
    """What must run first, trimmed; null for a placeholder and for words that define nothing."""
    text = F.trim(text, F.lit(" \t\r\n\x0b\x0c"))
    return F.when((text != "") & ~text.rlike(PLACEHOLDER) & text.rlike(DDL_VERB), text)


def _items(value: Column) -> Column:
    """The elements of a list as variants; empty if it is none."""
    return F.coalesce(F.when(kind_of(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def _occurrence(value: Column) -> Column:
    """Where something stands."""

    def of(o: Column) -> Column:
        named = lambda c: F.when(filled(o[c]), text(o[c]))
        return _let(number(o["startLine"], 0.0), lambda start: F.struct(text(o["file"]).alias("file"), start.alias("start_line"), number(o["endLine"], start).alias("end_line"), named("enclosingSymbol").alias("symbol"), named("triggeredBy").alias("triggered_by"), text(o["excerpt"]).alias("excerpt")))

    return _let(_fields(value, "file startLine endLine enclosingSymbol triggeredBy excerpt"), of)


def _evidence(value: Column) -> Column:
    def of(e: Column) -> Column:
        return _let(number(e["startLine"], 0.0), lambda start: F.struct(text(e["kind"]).alias("kind"), text(e["file"]).alias("file"), start.alias("start_line"), number(e["endLine"], start).alias("end_line"), text(e["quote"]).alias("quote"), text(e["relevance"]).alias("relevance")))

    return _let(_fields(value, "kind file startLine endLine quote relevance"), of)


def _finding(item: Column) -> Column:
    """All fields of a finding, and whether it is plausible."""

    def of(f: Column) -> Column:
        plausible = F.coalesce((kind_of(f["title"]) == "STRING") & (kind_of(f["original"]) == "STRING"), F.lit(False)) & filled(f["primaryOccurrence"])
        suggestion = lambda s: F.struct(
            text(s["proposed"]).alias("proposed"), text(s["rationale"]).alias("rationale"), text(s["equivalenceArgument"]).alias("equivalence"), F.transform(_items(s["assumptions"]), lambda a: text(a, "null")).alias("assumptions"),
            text(s["expectedImpact"]).alias("impact"), _let(text(s["requiredMigration"]), migration).alias("migration"),
        )
        return F.struct(
            plausible.alias("plausible"),
            text(f["siteId"], None).alias("site_id"),
            F.when(strict(f["kind"]) == "behavioural", "behavioural").otherwise("equivalent").alias("kind"),
            text(f["title"]).alias("title"),
            text(f["summary"]).alias("summary"),
            _let(strict(f["severity"]), lambda s: F.when(s.isin(*SEVERITIES), s).otherwise("medium")).alias("severity"),
            text(f["category"], "other").alias("category"),
            text(f["engine"], "unknown").alias("engine"),
            text(f["accessStyle"], "raw-sql").alias("access_style"),
            text(f["original"]).alias("original"),
            _occurrence(f["primaryOccurrence"]).alias("occurrence"),
            F.transform(_items(f["otherOccurrences"]), _occurrence).alias("others"),
            _let(_fields(f["suggestion"], "proposed rationale equivalenceArgument assumptions expectedImpact requiredMigration"), suggestion).alias("suggestion"),
            F.transform(_items(f["evidence"]), _evidence).alias("evidence"),
            number(f["modelConfidence"], 0.5).alias("confidence"),
        )

    return _let(_fields(item, "siteId kind title summary severity category engine accessStyle original primaryOccurrence otherOccurrences suggestion evidence modelConfidence"), of)


def findings(responses: DataFrame, name: str = "findings") -> DataFrame:
    """A row for each plausible finding of each response (id, raw), defaults filled in: (id, at, site_id, kind, title, summary, severity, category, engine, access_style, original,
    occurrence, others, proposed, rationale, equivalence, assumptions, impact, migration, evidence, confidence, repaired).

    A finding is plausible if its title and original are texts and it names a primary occurrence. at counts the elements of the list as they are, from 0. A
    response without a list has no rows (errors tells why); null responses are empty.
    """
    rows = listed(responses, name).select("id", "repaired", F.posexplode(F.transform("items", _finding)).alias("at", "f")).filter("f.plausible")
    return rows.select("id", "at", "f.*", "repaired").select("*", "suggestion.*").drop("plausible", "suggestion")


def declined(responses: DataFrame) -> DataFrame:
    """(id, site_id, why): sites that a response says it leaves, the first time it does."""
    of = lambda d: F.struct(text(d["siteId"]).alias("site_id"), text(d["why"]).alias("why"))
    read = listed(responses, "declined").select("id", F.posexplode(F.transform("items", lambda x: _let(_fields(x, "siteId why"), of))).alias("at", "d")).select("id", "at", "d.*").filter("site_id <> ''")
    return read.groupBy("id", "site_id").agg(F.min_by("why", "at").alias("why"))


def verdicts(responses: DataFrame) -> DataFrame:
    """(id, at, site_id, verdict, category, why): what a triage says of each site, the first time it does; problem, unsure, and clean for all else."""
    known = lambda v: _let(strict(v["verdict"]), lambda s: F.when(s.isin("problem", "unsure"), s).otherwise("clean"))
    of = lambda v: F.struct(text(v["id"]).alias("site_id"), known(v).alias("verdict"), text(v["category"], "other").alias("category"), text(v["why"]).alias("why"))
    read = listed(responses, "verdicts").select("id", F.posexplode(F.transform("items", lambda x: _let(_fields(x, "id verdict category why"), of))).alias("at", "v")).select("id", "at", "v.*").filter("site_id <> ''")
    first = read.groupBy("id", "site_id").agg(F.min(F.struct("at", "verdict", "category", "why")).alias("f"))
    return first.select("id", "f.at", "site_id", "f.verdict", "f.category", "f.why")


def flat(responses: DataFrame) -> DataFrame:
    """(id, at, title, original, path, line, proposed, migration, repaired) of responses whose findings are flat: titles, originals and paths are texts or null."""
    of = lambda f: F.struct(strict(f["title"]).alias("title"), strict(f["original"]).alias("original"), strict(f["path"]).alias("path"), number(f["line"], None).cast("int").alias("line"), text(f["proposed"], None).alias("proposed"), text(f["migration"], None).alias("migration"))
    items = F.transform("items", lambda x: _let(_fields(x, "title original path line proposed migration"), of))
    return listed(responses, "findings").select("id", "repaired", F.posexplode(items).alias("at", "f")).select("id", "at", "f.*", "repaired")
