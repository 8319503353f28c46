"""Pasted texts of databases and frameworks read as tables: plans, catalogs and query logs. Column expressions, a text a row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.functions.shapes import normalise_shape
from brindle.functions.statements import split_top_level, top_level
from brindle.operators.evidence import CHANGE, relative_change
from brindle.session import cut

# The lines of a plan in text form.
NODE = r"^(\s*)(?:->\s+)?([A-Z][A-Za-z ]*?)(?:\s+on\s+([\w.\"]+))?\s+\(cost="
ACTUAL = r"\(actual time=[\d.]+\.\.([\d.]+) rows=(\d+) loops=(\d+)\)"
ESTIMATE = r"rows=(\d+)\s+width="
HIT, READ = r"shared hit=(\d+)", r"shared (?:hit=\d+ )?read=(\d+)"
REMOVED, SORT = r"Rows Removed by Filter:\s*(\d+)", r"(?m)Sort Method:\s*(.+)$"
EXECUTION, PLANNING = r"Execution Time:\s*([\d.]+) ms", r"Planning Time:\s*([\d.]+) ms"
# Statements in logs, form by form.
DJANGO = r"^\s*\[\s*\{"
PRISMA = r"(?im)prisma:query\s+(.+)$"
RAILS = r"(?im)^\s*(?:\w+\s+)?(?:Load|Exists\?|Count|Create|Update|Destroy|Pluck)\s+\(([\d.]+)ms\)\s+(.+)$"
PLAIN = r"(?im)^\s*(?:\[[^\]]*\]\s*)?((?:SELECT|INSERT|UPDATE|DELETE|WITH)\b.+)$"
# An index definition up to its columns; brackets may stand in brackets twice.
INDEX_HEAD = r"(?i)CREATE\s+(UNIQUE\s+)?INDEX\s+(\S+)\s+ON\s+(?:[\w\"]+\.)?([\w\"]+)\s+USING\s+\w+\s*\("
_INNER = r"\((?:[^()\n]|\([^()\n]*\))*\)"
INDEX_DEFINITION = INDEX_HEAD + rf"((?:[^()\n]|{_INNER})*)\)"

_NODES = "array<struct<depth:int,node_type:string,relation:string,estimated_rows:bigint,actual_rows:double,total_ms:double,loops:bigint,blocks_hit:bigint,blocks_read:bigint,rows_removed:bigint,sort_method:string>>"


def _number(text: Column, pattern: str, kind: str = "bigint", group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast(kind)


def _text_nodes(read: DataFrame) -> DataFrame:
    """read (raw and other columns) with _own in place of raw: the nodes of a plan in text form (indent, head, text), each with the lines up to the next node; a
    second root ends the plan. Null without a text.

    Each step is read by several others: as the only element of an array that is exploded it is made once.
    """
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    is_node = lambda x: F.contains(x, F.lit("(cost=")) & x.rlike(NODE)
    rows = once(read, "_lines", F.split("raw", r"\r?\n")).drop("raw")
    rows = once(rows, "_heads", F.filter(F.transform("_lines", lambda x, i: F.when(is_node(x), F.struct(i.alias("at"), F.length(F.regexp_extract(x, NODE, 1)).alias("indent")))), lambda h: h.isNotNull()))
    # Nodes indented no more than the first one are roots of their own.
    roots = F.filter(F.transform("_heads", lambda h, k: F.when((k > 0) & (h["indent"] <= F.get("_heads", F.lit(0))["indent"]), k)), lambda k: k.isNotNull())
    own = F.slice("_heads", 1, F.coalesce(F.get(roots, F.lit(0)), F.size("_heads")))
    end = lambda k: F.coalesce(F.get("_heads", k + 1)["at"], F.size("_lines"))
    text = lambda h, k: F.array_join(F.slice("_lines", h["at"] + 1, end(k) - h["at"]), "\n").alias("text")
    return once(rows, "_own", F.transform(own, lambda h, k: F.struct(h["indent"].alias("indent"), F.get("_lines", h["at"]).alias("head"), text(h, k)))).drop("_lines", "_heads")


def _text_fields(n: Column | None = None) -> list[Column]:
    """What a node of _text_nodes tells, from node_type to sort_method; n: the node, else its columns."""
    head, text = (F.col("head"), F.col("text")) if n is None else (n["head"], n["text"])
    loops = _number(head, ACTUAL, group=3)
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return [
        F.trim(F.regexp_extract(head, NODE, 2)).alias("node_type"),
        F.nullif(F.replace(F.regexp_extract(head, NODE, 3), F.lit('"'), F.lit("")), F.lit("")).alias("relation"),
        _number(head, ESTIMATE).alias("estimated_rows"),
        (_number(head, ACTUAL, "double", 2) * loops).alias("actual_rows"),
        (_number(head, ACTUAL, "double") * loops).alias("total_ms"),
        loops.alias("loops"),
        _number(text, HIT).alias("blocks_hit"),
        _number(text, READ).alias("blocks_read"),
        _number(text, REMOVED).alias("rows_removed"),
        F.trim(first(SORT)).alias("sort_method"),
    ]


def plan_texts(captures: DataFrame) -> DataFrame:
    """(capture_id, node, indent, node_type, relation, estimated_rows, actual_rows, total_ms, loops, blocks_hit, blocks_read, rows_removed, sort_method)
    of the plans in text form among captures (capture_id, raw): nodes in pre-order from 0; rows and times of all loops together.
    A text without a plan has no rows. Numbers that a plan does not tell are null.
    """
    nodes = _text_nodes(captures.select("capture_id", "raw")).select("capture_id", F.posexplode("_own").alias("node", "n")).select("capture_id", "node", "n.*")
    return nodes.select("capture_id", "node", "indent", *_text_fields())


def plan_of(raw: str) -> dict | None:
    """The plan of the first JSON document in a text, which begins at its first bracket; what follows it is left out. None if there is no such document, or its Plan is no object."""
    start = min((k for k in (raw.find("["), raw.find("{")) if k >= 0), default=-1)
    try:
        document = json.JSONDecoder().raw_decode(raw, start)[0] if start >= 0 else None
    except (ValueError, RecursionError):
        return None
    first = document[0] if isinstance(document, list) and document else document
    plan = first.get("Plan") if isinstance(first, dict) else None
    return plan if isinstance(plan, dict) else None


def json_nodes(plan: dict) -> list[dict]:
    """Nodes of a plan in JSON form, in pre-order; a field of the wrong type is null, and what is no node has no row."""

    def number(node: dict, key: str) -> float | None:
        v = node.get(key)
        return v if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1 << 62 else None

    def whole(node: dict, key: str) -> int | None:
        v = number(node, key)
        return None if v is None else int(v)

    def said(node: dict, key: str) -> str | None:
        v = node.get(key)
        return v if isinstance(v, str) and v else None

    out, stack = [], [(plan, 0)]
    while stack:
        node, depth = stack.pop()
        loops, rows, ms = number(node, "Actual Loops"), number(node, "Actual Rows"), number(node, "Actual Total Time")
        sort, space = said(node, "Sort Method"), node.get("Sort Space Used")
        times = 1 if loops is None else loops
        out.append(
            {
                "depth": depth,
                "node_type": "Unknown" if node.get("Node Type") is None else str(node["Node Type"]),
                "relation": said(node, "Relation Name") or said(node, "Index Name"),
                "estimated_rows": whole(node, "Plan Rows"),
                "actual_rows": None if rows is None else float(rows * times),
                "total_ms": None if ms is None else float(ms * times),
                "loops": None if loops is None else int(loops),
                "blocks_hit": whole(node, "Shared Hit Blocks"),
                "blocks_read": whole(node, "Shared Read Blocks"),
                "rows_removed": whole(node, "Rows Removed by Filter"),
                "sort_method": f"{sort} {node.get('Sort Space Type')}: {space}kB" if sort and space else sort,
            }
        )
        children = node.get("Plans")
        stack += [(child, depth + 1) for child in reversed(children if isinstance(children, list) else []) if isinstance(child, dict)]
    return out


def plan_documents(captures: DataFrame) -> DataFrame:
    """The columns of plan_texts with depth in place of indent, for the plans in JSON form among captures (capture_id, raw).

    The first JSON document counts, whatever follows it; a text without one, or whose Plan is no object, has no rows. Fields of the wrong type are null.
    """
    return _documents(captures.filter(F.contains("raw", F.lit('"Plan"')))).select("capture_id", F.posexplode("_nodes").alias("node", "n")).select("capture_id", "node", "n.*")


def _documents(captures: DataFrame) -> DataFrame:
    """(capture_id, raw, _nodes): the nodes of a plan in JSON form, and raw null, or _nodes null and raw as it is."""
    kind = pa.list_(pa.struct([("depth", pa.int32()), ("node_type", pa.string()), ("relation", pa.string()), ("estimated_rows", pa.int64()), ("actual_rows", pa.float64()), ("total_ms", pa.float64()), ("loops", pa.int64()), ("blocks_hit", pa.int64()), ("blocks_read", pa.int64()), ("rows_removed", pa.int64()), ("sort_method", pa.string())]))
    id_kind = dict(captures.dtypes)["capture_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(1).to_pylist()
            plans = [plan_of(raw) if raw is not None and '"Plan"' in raw else None for raw in raws]
            left = pa.array([raw if p is None else None for raw, p in zip(raws, plans)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), left, pa.array([None if p is None else json_nodes(p) for p in plans], kind)], ["capture_id", "raw", "_nodes"])

    return captures.select("capture_id", "raw").mapInArrow(run, f"capture_id {id_kind}, raw string, _nodes {_NODES}")


def _plans(read: DataFrame) -> DataFrame:
    """A row for each row of _documents (with what other columns it has), and _plan, its nodes in JSON or else in text form: one pass, without a join of the two."""
    rows = _text_nodes(read)
    fields = "node_type relation estimated_rows actual_rows total_ms loops blocks_hit blocks_read rows_removed sort_method".split()
    plan = F.coalesce(F.transform("_nodes", lambda n: F.struct(*[n[f].alias(f) for f in fields])), F.transform("_own", lambda n: F.struct(*_text_fields(n))))
    return rows.select(*[c for c in rows.columns if c not in ("_nodes", "_own")], F.explode(F.array(plan)).alias("_plan"))


def plan_nodes(captures: DataFrame) -> DataFrame:
    """(capture_id, node, node_type, ..., sort_method): the nodes of each capture's plan, in JSON or else in text form."""
    return _plans(_documents(captures)).select("capture_id", F.posexplode("_plan").alias("node", "n")).select("capture_id", "node", "n.*")


def plan_summary(captures: DataFrame) -> DataFrame:
    """(capture_id, nodes, blocks_read, blocks_hit, rows_removed, seq_scans, disk_sorts, buffers, timed, root_ms, total_ms, planning_ms) of each
    capture with a plan, in JSON or else in text form. A capture is a row from its text to its summary: nothing is shuffled."""
    either = lambda text, key: F.coalesce(_number(F.col("raw"), text, "double"), _number(F.col("raw"), rf'"{key}":\s*([\d.]+)', "double"))
    # The times are read before the text is left out: they go to the next step beside the id.
    timed = captures.select(F.struct("capture_id", either(EXECUTION, "Execution Time").alias("total_ms"), either(PLANNING, "Planning Time").alias("planning_ms")).alias("capture_id"), "raw")
    rows = _plans(_documents(timed)).filter(F.size("_plan") > 0)
    total = lambda f: F.aggregate("_plan", F.lit(None).cast("bigint"), lambda t, n: F.coalesce(t + n[f], n[f], t))
    names = lambda test, f: F.array_sort(F.array_distinct(F.filter(F.transform("_plan", lambda n: F.when(test(n), n[f])), lambda v: v.isNotNull())))
    root_ms = F.get("_plan", F.lit(0))["total_ms"]
    return rows.select(
        "capture_id.capture_id",
        F.size("_plan").cast("bigint").alias("nodes"),
        total("blocks_read").alias("blocks_read"),
        total("blocks_hit").alias("blocks_hit"),
        total("rows_removed").alias("rows_removed"),
        names(lambda n: n["node_type"] == "Seq Scan", "relation").alias("seq_scans"),
        names(lambda n: n["sort_method"].rlike("(?i)disk|external"), "sort_method").alias("disk_sorts"),
        F.exists("_plan", lambda n: n["blocks_read"].isNotNull() | n["blocks_hit"].isNotNull()).alias("buffers"),
        root_ms.isNotNull().alias("timed"),
        root_ms.alias("root_ms"),
        "capture_id.total_ms",
        "capture_id.planning_ms",
    )


def plan_changes(a: str, b: str) -> tuple[Column, Column]:
    """(gains, losses) between two plan summaries, structs in the columns a and b: seq-scan, disk-sort, blocks, time, planning; times only where both plans have them."""
    of = lambda side, n: F.col(f"{side}.{n}")
    change = lambda n, known=True: F.when(F.lit(True) if known is True else known, relative_change(of(a, n).cast("double"), of(b, n).cast("double")))
    ms = lambda side: F.coalesce(of(side, "total_ms"), of(side, "root_ms"))
    parts = {
        "blocks": change("blocks_read", of(a, "buffers") & of(b, "buffers")),
        "time": F.when(of(a, "timed") & of(b, "timed"), relative_change(ms(a), ms(b))),
        "planning": change("planning_ms"),
    }
    some = lambda side, n: F.size(of(side, n)) > 0
    went = lambda n, x, y: some(x, n) & ~some(y, n)
    listed = lambda x, y, test: F.filter(F.array(F.when(went("seq_scans", x, y), "seq-scan"), F.when(went("disk_sorts", x, y), "disk-sort"), *[F.when(test(c), n) for n, c in parts.items()]), lambda n: n.isNotNull())
    return listed(a, b, lambda c: c <= -CHANGE), listed(b, a, lambda c: c >= CHANGE)


# Categories whose claim is a number of round trips.
ROUND_TRIP = ("n-plus-one", "round-trip", "batching")


def verdict(category: Column, logs: tuple[Column, Column], plans: tuple[Column, Column], gains: Column, losses: Column) -> Column:
    """What captures of both sides say: logs (numbers of statements) before plans (whether there is one); a claim of round trips is not settled by plans.

    Any loss is a regression, whatever was gained."""
    both = lambda pair: pair[0].isNotNull() & pair[1].isNotNull()
    counted = F.when(logs[1] > logs[0], "regression").when(logs[1] == logs[0], "no-difference").otherwise("confirmed")
    planned = F.when(F.size(losses) > 0, "regression").when(F.size(gains) > 0, "confirmed").otherwise("no-difference")
    return F.when(both(logs), counted).when(category.isin(*ROUND_TRIP), "insufficient-evidence").when(F.coalesce(plans[0] & plans[1], F.lit(False)), planned).otherwise("insufficient-evidence")


def tabular(captures: DataFrame) -> DataFrame:
    """captures (capture_id, raw) with t, struct(head, rows) of output in columns: separated by bars, else tabs, else commas as the first line has
    them; rules, row counts and ragged rows are left out. t is null where no line has as many cells as the first.

    Each step is a column of its own, so that the next ones read it instead of making it again.
    """

    def cells(line: Column) -> Column:
        parts = F.when(F.col("_sep") == "|", F.split(line, r"\|", -1)).when(F.col("_sep") == "\t", F.split(line, "\t", -1)).otherwise(F.split(line, ",", -1))
        trimmed = F.transform(parts, lambda x: F.trim(x))
        return F.slice(trimmed, 1, F.size(trimmed) - F.when(F.element_at(trimmed, -1) == "", 1).otherwise(0))

    lines = F.filter(F.transform(F.split("raw", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get("_lines", F.lit(0))
    sep = F.when(F.contains(first, F.lit("|")), "|").when(F.contains(first, F.lit("\t")), "\t").otherwise(",")
    kept = F.filter(F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))), lambda x: ~x.rlike(r"^[-+\s|]+$") & ~x.rlike(r"^\(\d+ rows?\)$"))
    read = captures.select("capture_id", "raw", lines.alias("_lines")).select("*", sep.alias("_sep"), kept.alias("_kept"))
    read = read.select("*", F.transform(cells(first), lambda x: F.lower(x)).alias("_head"), F.transform("_kept", cells).alias("_cells"))
    read = read.select("*", F.filter("_cells", lambda r: F.size(r) == F.size("_head")).alias("_rows"))
    return read.select("capture_id", "raw", F.when((F.size("_head") >= 2) & (F.size("_rows") > 0), F.struct(F.col("_head").alias("head"), F.col("_rows").alias("rows"))).alias("t"))


def _cell(row: str, key: str) -> Column:
    """A row's cell under a heading; null without that heading."""
    at = F.array_position("t.head", key)
    return F.when(at > 0, F.get(row, (at - 1).cast("int")))


_plain_name = lambda c: F.replace(F.replace(c, F.lit('"'), F.lit("")), F.lit("`"), F.lit(""))


def catalogs(captures: DataFrame) -> DataFrame:
    """captures (capture_id, raw) with form, the first of pg-indexes, show-index, pg-stats, table-stats, index-usage that reads it (null if none does), and t, its table.

    The texts are read once, to a table in the shared folder: three readers follow, whose filters would otherwise be put before the reading, and do it again.
    """
    read = tabular(captures)
    has = lambda *names: F.arrays_overlap("t.head", F.array(*[F.lit(n) for n in names]))
    form = (
        F.when(F.col("raw").rlike(INDEX_HEAD), "pg-indexes")
        .when(has("key_name") & has("column_name"), "show-index")
        .when(has("attname") & has("n_distinct", "null_frac", "avg_width"), "pg-stats")
        .when(has("relname") & has("seq_scan") & ~has("indexrelname"), "table-stats")
        .when(has("indexrelname") & has("idx_scan"), "index-usage")
    )
    return cut(read.withColumn("form", form), "catalogs")


def observed_indexes(read: DataFrame) -> DataFrame:
    """(capture_id, tab, name, cols, uniq, scans, size_bytes, ord) of the indexes that catalogs lists; ord: their order in the capture."""
    every = lambda g: F.regexp_extract_all("raw", F.lit(INDEX_DEFINITION), F.lit(g))
    found = F.arrays_zip(every(3).alias("tab"), every(2).alias("name"), every(4).alias("cols"), every(1).alias("uniq"))
    number = F.lit(None).cast("bigint")
    defined = read.filter("form = 'pg-indexes'").select("capture_id", F.posexplode(found).alias("ord", "m")).select(
        "capture_id", _plain_name(F.col("m.tab")).alias("tab"), _plain_name(F.col("m.name")).alias("name"), F.transform(split_top_level(top_level(F.col("m.cols"))), _plain_name).alias("cols"), (F.trim("m.uniq") != "").alias("uniq"), number.alias("scans"), number.alias("size_bytes"), "ord"
    )
    rows = read.select("capture_id", "form", "t", F.posexplode("t.rows").alias("ord", "r"))
    cell = lambda k: _cell("r", k)
    # One row a column, in the order of the rows.
    shown = rows.filter("form = 'show-index'").select("capture_id", "ord", cell("table").alias("tab"), cell("key_name").alias("name"), cell("column_name").alias("col"), (cell("non_unique") == "0").alias("uniq")).filter("name <> ''")
    folded = shown.groupBy("capture_id", "name").agg(F.min_by("tab", "ord").alias("tab"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "col"))), lambda x: x["col"]).alias("cols"), F.min_by("uniq", "ord").alias("uniq"), F.min("ord").alias("ord"))
    used = rows.filter("form = 'index-usage'").select("capture_id", F.coalesce(cell("relname"), F.lit("<unknown>")).alias("tab"), cell("indexrelname").alias("name"), F.array().cast("array<string>").alias("cols"), F.lit(False).alias("uniq"), cell("idx_scan").try_cast("bigint").alias("scans"), cell("size_bytes").try_cast("bigint").alias("size_bytes"), "ord").filter("name <> ''")
    return defined.unionByName(folded.withColumns({"scans": number, "size_bytes": number})).unionByName(used)


def observed_columns(read: DataFrame) -> DataFrame:
    """(capture_id, tab, col, distinct, null_fraction, width) of column statistics."""
    rows = read.filter("form = 'pg-stats'").select("capture_id", "t", F.explode("t.rows").alias("r"))
    cell = lambda k: _cell("r", k)
    number = lambda k: cell(k).try_cast("double")
    return rows.select("capture_id", F.coalesce(cell("tablename"), F.lit("<unknown>")).alias("tab"), cell("attname").alias("col"), number("n_distinct").alias("distinct"), number("null_frac").alias("null_fraction"), number("avg_width").alias("width")).filter("col <> ''")


def observed_tables(read: DataFrame) -> DataFrame:
    """(capture_id, tab, live_rows, seq_scans, index_scans) of table statistics."""
    rows = read.filter("form = 'table-stats'").select("capture_id", "t", F.explode("t.rows").alias("r"))
    number = lambda k: _cell("r", k).try_cast("bigint")
    return rows.select("capture_id", _cell("r", "relname").alias("tab"), number("n_live_tup").alias("live_rows"), number("seq_scan").alias("seq_scans"), number("idx_scan").alias("index_scans")).filter("tab <> ''")


def query_logs(captures: DataFrame) -> DataFrame:
    """(capture_id, form, statements, total_ms) of captures (capture_id, raw): the first form that finds statements; form 'unreadable' for broken JSON, null where none finds any."""
    rows = F.from_json("raw", "array<struct<sql:string,time:string>>")
    read = captures.select("capture_id", "raw", F.when(F.col("raw").rlike(DJANGO), rows).alias("_rows"), F.col("raw").rlike(DJANGO).alias("_json"))
    every = lambda p, g=1: F.transform(F.regexp_extract_all("raw", F.lit(p), F.lit(g)), lambda x: F.trim(x))
    from_json = F.transform(F.filter("_rows", lambda r: r["sql"].isNotNull()), lambda r: r["sql"])
    total = lambda numbers: F.aggregate(numbers, F.lit(0.0), lambda s, x: s + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    read = read.select("capture_id", "_json", "_rows", from_json.alias("django"), every(PRISMA).alias("prisma"), every(RAILS, 2).alias("rails"), every(PLAIN).alias("plain"), (total(F.transform("_rows", lambda r: r["time"])) * 1000).alias("_seconds"), total(every(RAILS)).alias("_ms"))
    some = lambda c: F.size(c) > 0
    form = F.when(F.col("_json") & F.col("_rows").isNull(), "unreadable").when(some("django"), "django").when(some("prisma"), "prisma").when(some("rails"), "rails").when(some("plain"), "plain")
    ms = F.when(form == "django", F.col("_seconds")).when(form == "rails", F.col("_ms"))
    statements = F.when(form == "django", F.col("django")).when(form == "prisma", F.col("prisma")).when(form == "rails", F.col("rails")).when(form == "plain", F.col("plain"))
    return read.select("capture_id", form.alias("form"), statements.alias("statements"), F.when(ms > 0, F.round(ms, 1)).alias("total_ms"))


def log_shapes(logs: DataFrame, most: int = 20) -> DataFrame:
    """(capture_id, shape, n): the shapes of each log by how often they run, ties in the order of the log; the top `most` is the feature."""
    rows = logs.select("capture_id", F.posexplode("statements").alias("at", "sql")).select("capture_id", "at", normalise_shape(F.col("sql")).alias("shape"))
    counts = rows.groupBy("capture_id", "shape").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "at", "shape", "n"))), 1, most)
    return counts.groupBy("capture_id").agg(best.alias("s")).select("capture_id", F.explode("s").alias("s")).select("capture_id", "s.shape", "s.n")


# What a schema in files cannot tell, and what of a capture answers it.
UNKNOWABLE = (
    ("Row counts", "live rows of a table"), ("Column selectivity", "distinct values of a column"), ("Which indexes actually exist", "an index"), ("Index bloat", "scans of an index"),
)


def unknowable_left(read: DataFrame) -> DataFrame:
    """(capture_id, fact): of each capture the facts that it does not answer."""
    facts = F.array(*[F.lit(f) for f, _ in UNKNOWABLE])
    answers = (
        observed_tables(read).filter("live_rows IS NOT NULL").select("capture_id", F.lit(0).alias("k"))
        .union(observed_columns(read).filter("distinct IS NOT NULL").select("capture_id", F.lit(1)))
        .union(observed_indexes(read).select("capture_id", F.lit(2)))
        .union(observed_indexes(read).filter("scans IS NOT NULL").select("capture_id", F.lit(3)))
    )
    answered = answers.groupBy("capture_id").agg(F.collect_set("k").alias("_k"))
    left = F.array_except(facts, F.transform("_k", lambda k: F.get(facts, k)))
    return read.select("capture_id").join(answered, "capture_id", "left").select("capture_id", F.explode(F.coalesce(left, facts)).alias("fact"))


LOW_DISTINCT, SMALL_TABLE = 10, 1000


def against_observed(proposed: DataFrame, indexes: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, observed, existing, how, low_distinct, small_table) for proposed indexes (id, tab, cols).

    observed: whether any capture covers the table; existing: the first index with the same columns, else the first that begins with them
    (how: exact, covering); low_distinct: the leading column has at most LOW_DISTINCT values; small_table: fewer than SMALL_TABLE rows.
    Every observed index stands under each beginning of its columns, so that the join is one of equality.
    """
    low = lambda c: F.lower(F.col(c))
    p = proposed.select("id", low("tab").alias("_t"), F.transform("cols", lambda c: F.lower(c)).alias("_c"))
    covered = indexes.select(low("tab").alias("_t")).union(columns.select(low("tab"))).union(tables.select(low("tab"))).filter("_t <> '<unknown>'").distinct()
    names = F.transform("cols", lambda c: F.lower(c))
    live = indexes.filter(F.size("cols") > 0).select(low("tab").alias("_t"), "name", "ord", names.alias("_all"), F.explode(F.transform(F.sequence(F.lit(1), F.size("cols")), lambda n: F.slice(names, 1, n))).alias("_c"))
    longer = F.size("_all") > F.size("_c")
    # One row for each beginning of observed columns: a proposal meets one row, however many indexes begin alike.
    first = live.groupBy("_t", "_c").agg(F.min(F.struct(longer.alias("longer"), "ord", "name")).alias("_first"))
    met = join_hot(p, first, ["_t", "_c"], hot_keys(p.groupBy("_t", "_c").agg(F.count("*").alias("n")), ["_t", "_c"]), ["id"])
    found = met.groupBy("id").agg(F.min("_first").alias("_f"))
    distinct = columns.groupBy(low("tab").alias("_t"), low("col").alias("_lead")).agg(F.min("distinct").alias("distinct"))
    rows = tables.groupBy(low("tab").alias("_t")).agg(F.min("live_rows").alias("live_rows"))
    told = p.withColumn("_lead", F.get("_c", F.lit(0))).join(covered.withColumn("_seen", F.lit(True)), "_t", "left").join(found, "id", "left").join(distinct, ["_t", "_lead"], "left").join(rows, "_t", "left")
    none = F.col("_f").isNull() & F.col("_seen")
    return told.select(
        "id",
        F.coalesce("_seen", F.lit(False)).alias("observed"),
        F.col("_f.name").alias("existing"),
        F.when(F.col("_f.longer"), "covering").when(~F.col("_f.longer"), "exact").alias("how"),
        F.coalesce(none & F.col("distinct").between(1, LOW_DISTINCT), F.lit(False)).alias("low_distinct"),
        F.coalesce(none & (F.col("live_rows") < SMALL_TABLE), F.lit(False)).alias("small_table"),
    )
