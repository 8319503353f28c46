"""Tables and indexes that source files declare, read with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.functions.statements import shown, split_top_level, top_level

# Declarations; groups are told beside each. Text in brackets is hidden while the first two are looked for.
TABLE_FORM = r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([`\"\[\]\w.]+)\s*\(([^()]*)\)"  # name, body
INDEX_FORM = r"(?i)\bCREATE\s+(UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?([`\"\w.]+)\s+ON\s+(?:ONLY\s+)?([`\"\[\]\w.]+)(?:\s+USING\s+\w+)?\s*\(([^()]*)\)"  # unique, name, table, columns
INLINE_KEY = r"(?i)(UNIQUE|PRIMARY)\s+KEY\s*\(([^()]*)\)"  # kind, columns
MODEL_FORM = r"\bmodel\s+(\w+)\s*\{([^{}]*)\}"  # name, body
MODEL_INDEX = r"@@(index|unique)\s*\(\s*\[([^\]]*)\]"  # kind, columns
RAILS_FORM = r"(?im)add_index\s+:?[\"']?(\w+)[\"']?\s*,\s*(\[[^\]]*\]|:\w+|[\"']\w+[\"'])(.*)$"  # table, columns, options
ALEMBIC_FORM = r"(?im)op\.create_index\s*\(\s*(?:[\"']([\w]+)[\"']\s*,\s*)?[\"'](\w+)[\"']\s*,\s*\[([^\]]*)\](.*)$"  # name, table, columns, options
# What begins a part of a table that is no column.
CONSTRAINTS = r"(?i)^(?:PRIMARY|UNIQUE|FOREIGN|CONSTRAINT|CHECK|INDEX|KEY)\b"
#: Room for the places of one form in a file's order.
_FORM = 1_000_000


def unquoted(name: Column) -> Column:
    """A name without quotes and what qualifies it."""
    return F.element_at(F.split(F.regexp_replace(name, r"[`\"\[\]]", ""), r"\."), -1)


def column_list(listed: Column) -> Column:
    """Names of a list in lower case, without brackets, quotes, marks and sort orders."""
    first = lambda c: F.lower(F.get(F.split(F.regexp_replace(F.trim(c), r"^[:'\"`]+|['\"`]+$", ""), r"\s+"), F.lit(0)))
    return F.filter(F.transform(F.split(F.regexp_replace(listed, r"[\[\]]", ""), ","), first), lambda c: c != "")


def _found(files: DataFrame, text: Column, pattern: str, **groups: int) -> DataFrame:
    """(path, at, m): the matches of a pattern in each file, in order; m has the named groups."""
    every = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])
    return files.filter(text.rlike(pattern)).select("path", F.posexplode(every).alias("at", "m"))


def _hidden(files: DataFrame) -> DataFrame:
    """Files that may declare something in SQL, with _top, their text with brackets hidden."""
    some = files.filter(F.col("content").rlike(r"(?i)\bCREATE\s+(?:TABLE|(?:UNIQUE\s+)?INDEX)\b"))
    return some.select("path", top_level(F.col("content")).alias("_top"))


def _tables(files: DataFrame) -> DataFrame:
    """(path, at, tab, parts): tables of SQL files, and the parts of their definitions."""
    rows = _found(_hidden(files), F.col("_top"), TABLE_FORM, tab=1, body=2)
    return rows.select("path", "at", unquoted(F.col("m.tab")).alias("tab"), split_top_level(top_level(shown(F.col("m.body")))).alias("parts"))


def _models(files: DataFrame) -> DataFrame:
    rows = _found(files.filter(F.col("path").endswith(".prisma")), F.col("content"), MODEL_FORM, tab=1, body=2)
    return rows.select("path", "at", F.col("m.tab").alias("tab"), F.col("m.body").alias("body"))


def index_facts(files: DataFrame) -> DataFrame:
    """(path, source, name, tab, cols, uniq, ord): every index that the files (path, content) declare, keys in tables and models too, in the order of the forms and of the text."""
    inline = _tables(files).select("path", "at", "tab", F.posexplode(F.filter("parts", lambda p: p.rlike(INLINE_KEY))).alias("k", "p"))
    kind = F.lower(F.regexp_extract("p", INLINE_KEY, 1))
    keys = inline.select("path", F.lit("key").alias("source"), F.concat_ws("_", "tab", kind).alias("name"), "tab", column_list(F.regexp_extract("p", INLINE_KEY, 2)).alias("cols"), F.lit(True).alias("uniq"), (F.col("at") * 100 + F.col("k")).cast("long").alias("ord"))
    sql = _found(_hidden(files), F.col("_top"), INDEX_FORM, uniq=1, name=2, tab=3, cols=4)
    named = sql.select("path", F.lit("sql").alias("source"), unquoted(F.col("m.name")).alias("name"), unquoted(F.col("m.tab")).alias("tab"), column_list(shown(F.col("m.cols"))).alias("cols"), (F.trim("m.uniq") != "").alias("uniq"), (F.lit(_FORM) + F.col("at")).cast("long").alias("ord"))
    every = lambda g: F.regexp_extract_all("body", F.lit(MODEL_INDEX), F.lit(g))
    model = _models(files).select("path", "at", "tab", F.posexplode(F.arrays_zip(every(1).alias("kind"), every(2).alias("cols"))).alias("k", "m"))
    prisma = model.select("path", F.lit("prisma").alias("source"), F.concat_ws("_", "tab", F.regexp_replace("m.cols", r"\W+", "_")).alias("name"), "tab", column_list(F.col("m.cols")).alias("cols"), (F.col("m.kind") == "unique").alias("uniq"), (F.lit(2 * _FORM) + F.col("at") * 100 + F.col("k")).cast("long").alias("ord"))
    r = _found(files, F.col("content"), RAILS_FORM, tab=1, cols=2, more=3)
    rails = r.select("path", F.lit("rails").alias("source"), F.concat(F.col("m.tab"), F.lit("_idx")).alias("name"), F.col("m.tab").alias("tab"), column_list(F.col("m.cols")).alias("cols"), F.col("m.more").rlike(r"unique:\s*true").alias("uniq"), (F.lit(3 * _FORM) + F.col("at")).cast("long").alias("ord"))
    o = _found(files, F.col("content"), ALEMBIC_FORM, name=1, tab=2, cols=3, more=4)
    alembic = o.select("path", F.lit("alembic").alias("source"), F.when(F.col("m.name") != "", F.col("m.name")).otherwise(F.concat(F.col("m.tab"), F.lit("_idx"))).alias("name"), F.col("m.tab").alias("tab"), column_list(F.col("m.cols")).alias("cols"), F.col("m.more").rlike(r"(?i)unique\s*=\s*true").alias("uniq"), (F.lit(4 * _FORM) + F.col("at")).cast("long").alias("ord"))
    return keys.unionByName(named).unionByName(prisma).unionByName(rails).unionByName(alembic)


def table_facts(files: DataFrame) -> DataFrame:
    """(tab, path, cols): tables and models, in lower case, and their columns; of one declared again, the last declaration by path and place counts."""
    columns = F.filter(F.transform(F.filter("parts", lambda p: ~p.rlike(CONSTRAINTS)), lambda p: unquoted(F.get(F.split(p, r"\s+"), F.lit(0)))), lambda c: c != "")
    sql = _tables(files).select("path", "at", F.lower("tab").alias("tab"), columns.alias("cols"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^\s*\w+\s+\w+") & ~F.trim(x).startswith("@@"))
    models = _models(files).select("path", "at", F.lower("tab").alias("tab"), F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*(\w+)", 1))).alias("cols"))
    last = F.struct("path", "at")
    return sql.unionByName(models).groupBy("tab").agg(F.max_by("path", last).alias("path"), F.max_by("cols", last).alias("cols"))


def proposed_indexes(texts: DataFrame) -> DataFrame:
    """(id, tab, cols, uniq) of the first index that each text (id, text) would create; texts that create none have no row."""
    form = INDEX_FORM.replace(r"([`\"\w.]+)\s+ON", r"([`\"\w.]+)?\s*ON")
    read = texts.select("id", top_level(F.col("text")).alias("_top")).filter(F.col("_top").rlike(form))
    of = lambda g: F.regexp_extract("_top", form, g)
    return read.select("id", unquoted(of(3)).alias("tab"), column_list(shown(of(4))).alias("cols"), (F.trim(of(1)) != "").alias("uniq"))


def index_advice(proposed: DataFrame, declared: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(id, duplicate_of, covered_by, unknown, known_table) for proposed indexes (id, tab, cols): the first declared one (ord) with the same columns,
    the first longer one that begins with them, and, with tables (tab, cols), the columns that the table does not declare."""
    keys = ["_t", "_prefix"]
    d = declared.select(F.lower("tab").alias("_t"), F.col("ord").alias("_ord"), F.size("cols").alias("_size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("cols")), lambda n: F.slice("cols", 1, n))).alias("_prefix"))
    p = proposed.select("id", F.lower("tab").alias("_t"), F.col("cols").alias("_prefix"))
    same = F.col("_size") == F.size("_prefix")
    # One row for each beginning of declared columns: a proposal meets one row, however many indexes begin alike.
    first = d.groupBy(*keys).agg(F.min(F.when(same, F.col("_ord"))).alias("_same"), F.min(F.when(~same, F.col("_ord"))).alias("_longer"))
    met = join_hot(p, first, keys, hot_keys(p.groupBy(*keys).agg(F.count("*").alias("n")), keys), ["id"])
    hits = met.groupBy("id").agg(F.min("_same").alias("duplicate_of"), F.min("_longer").alias("covered_by"))
    told = proposed.select("id", "tab", "cols").join(hits, "id", "left")
    if tables is None:
        return told.select("id", "duplicate_of", "covered_by")
    known = tables.select(F.col("tab").alias("_t"), F.transform("cols", lambda c: F.lower(c)).alias("_known"))
    joined = told.join(known, F.lower("tab") == F.col("_t"), "left")
    unknown = F.when(F.col("_known").isNotNull(), F.filter("cols", lambda c: ~F.array_contains("_known", F.lower(c)))).otherwise(F.array().cast("array<string>"))
    return joined.select("id", "duplicate_of", "covered_by", unknown.alias("unknown"), F.col("_known").isNotNull().alias("known_table"))
