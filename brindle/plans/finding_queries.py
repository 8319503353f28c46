"""Queries over findings: a finding for each customer's file, checked against the files, counted, judged and reported."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.engines import ENGINES, FAMILIES
from brindle.operators import ddl, recipes, review
from brindle.plans.code_queries import code_files
from brindle.tables import table

_CLOSE = "Whatever is asked, the same rows, columns, order and duplicates come back."


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each customer with a Python view: by j, a seventh each is right, cites no file, a line outside, another excerpt, another original, evidence that is nowhere, or a quote that is nowhere."""
    per = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").filter("o_custkey % 4 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    c, j, k = F.col("o_custkey"), (F.col("o_custkey") / 4).cast("int"), F.col("k")
    path = _text("app/views/v", c, ".py")
    sql = _text("SELECT o_totalprice FROM orders WHERE o_orderkey = ", k)
    v, w = j % 7, j % 5
    proposed = F.when(w == 0, F.replace(sql, F.lit("SELECT"), F.lit("SELECT DISTINCT"))).when(w == 1, F.replace(sql, F.lit("= "), F.lit("IN "))).when(w == 2, _text(sql, " LIMIT 1")).when(w == 3, _text("CREATE INDEX ON orders (o_orderkey); ", sql)).otherwise(_text(sql, " "))
    evidence = F.array(F.struct(F.when(v == 5, "nowhere.py").otherwise(path).alias("file"), F.when(v == 6, "no such words stand anywhere in it").otherwise(_text("class C", c, "View:")).alias("quote"), F.lit("code").alias("kind")))
    return per.select(
        c.alias("id"), F.when(v == 1, _text("gone/", path)).otherwise(path).alias("path"), F.when(v == 2, 10_000_000).otherwise(5).alias("line"), F.when(v == 2, 10_000_000).otherwise(5).alias("end_line"),
        F.when(v == 3, "entirely different words, on no line").otherwise(_text('            cursor.execute("', sql, '")')).alias("excerpt"), F.when(v == 4, F.lit("SELECT zz9 FROM zz8 WHERE zz7 = 1 AND zz6 = 2")).otherwise(sql).alias("original"),
        F.when(v == 4, F.lit("SELECT zz9 FROM zz8 WHERE zz7 = 1 AND zz6 = 2 LIMIT 3")).otherwise(proposed).alias("proposed"), F.lit("equivalent").alias("kind"), F.when(j % 2 == 0, "n-plus-one").otherwise("missing-index").alias("category"), F.when(j % 3 == 0, F.lit("")).otherwise(F.lit(_CLOSE)).alias("argument"),
        F.lit("").alias("rationale"), F.lit(None).cast("string").alias("migration"), evidence.alias("evidence"),
    )


def grounded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = review.grounded(findings(spark, sf_dir), code_files(spark, sf_dir))
    return g.select("id", "grounding", "kind", F.array_join("citations", ",").alias("citations"), F.array_join("analysis", ",").alias("analysis"), F.greatest(F.coalesce(F.size("evidence"), F.lit(0)), F.lit(0)).alias("evidence"), "loop_depth", "symbol", "trigger", F.col("equivalence.status").alias("status"))


_SCHEMA = "CREATE TABLE t0 (a int, b int);\nCREATE INDEX i0 ON t0 (b);\nCREATE INDEX i1 ON t1 (b, c);\nCREATE INDEX i3 ON t3 (c);\nCREATE UNIQUE INDEX i4 ON t4 (b);\n"


def reviewed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each customer's file that proposes an index: one that is there already, one that a longer one covers, one with and one without evidence; half of them change the statement."""
    k, j = F.col("c_custkey"), (F.col("c_custkey") % 5).cast("string")
    statement = F.concat(F.lit("SELECT a, b FROM t"), j, F.lit(" WHERE b = 1"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("svc/c"), k.cast("string"), F.lit(".py")).alias("path"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), statement.alias("excerpt"), statement.alias("original"),
        F.when(k % 2 == 0, statement).otherwise(F.concat(F.lit("SELECT a FROM t"), j, F.lit(" WHERE b = 1 LIMIT 9"))).alias("proposed"), F.when(k % 2 == 0, "equivalent").otherwise("behavioural").alias("kind"), F.lit("missing-index").alias("category"), F.lit("postgres").alias("engine"),
        F.lit("").alias("argument"), F.lit("Needs CREATE INDEX first").alias("rationale"), F.when(k % 3 > 0, F.concat(F.lit("CREATE INDEX n ON t"), j, F.lit(" (b)"))).alias("migration"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("db/schema.sql").alias("file"), F.lit("CREATE TABLE t0").alias("quote"), F.lit("schema").alias("kind")))).otherwise(F.array().cast("array<struct<file:string,quote:string,kind:string>>")).alias("evidence"),
    )
    code = rows.select("path", F.concat(F.lit("rows = db.execute(\""), "original", F.lit("\")\n")).alias("content"))
    files = code.unionByName(spark.range(1).select(F.lit("db/schema.sql").alias("path"), F.lit(_SCHEMA).alias("content")))
    told = review.reviewed(rows, files)
    return told.select("id", "grounding", "kind", F.array_join("analysis", ",").alias("analysis"), F.array_join("counted", "; ").alias("counted"), F.array_join("unmeasured", ",").alias("unmeasured"), "questionable", F.col("equivalence.status").alias("status"))


#: Pairs of texts, by key: category, engine, original, proposed, what is counted, how much is unmeasured, and the instruments.
_CHANGES = (
    ("full-scan", "postgres", "SELECT * FROM t", "SELECT a, b FROM t LIMIT 5", "2 named columns instead of every column; Caps the result at 5 row(s), unbounded before", 2, "plan,statistics", False),
    ("full-scan", "vector", "SELECT a, b, c FROM t", "SELECT a FROM t WHERE x = 1", "2 fewer column(s)", 2, "plan,statistics", False),
    ("missing-index", "pgvector", "SELECT a FROM t", "SELECT a FROM t", "", 5, "plan,statistics", True),
    ("redundant-index", "mysql", "CREATE INDEX i ON t (a)", "DROP INDEX i", "Changes an index definition, which every write pays for", 1, "claim,statistics", False),
    ("n-plus-one", "snowflake", "for o in q:\n    Order.objects.get(id=o)", "Order.objects.filter(id__in=q).count()", "Moves the query out of the loop; One set-membership predicate instead of a per-row lookup", 3, "claim", False),
    ("other", "mysql", "Order.objects.all().count() + Order.objects.count()", "Order.objects.all().exists()", "1 database call(s), 2 before; Stops at the first row instead of counting all", 1, "count-queries,", False),
    ("other", "mysql", "Order.objects.order_by('a').first()", "Order.objects.aggregate(Max('a'))", "One Max aggregate instead of an ordered fetch", 1, "count-queries,", False),
    ("other", "mysql", "Order.objects.filter(a=1).get()", "Order.objects.filter(a=1).only('a')[:3]", "No database call within the code shown, 1 before; moved or gone is not decidable; 1 named column(s) instead of whole instances; Caps the result at 3 row(s) of the calls, unbounded before; Adds eager loading (only)", 1, "count-queries,", False),
    ("other", "mysql", "@OneToMany(fetch = FetchType.EAGER) List<B> b;", "@OneToMany(fetch = FetchType.LAZY) List<B> b;", "Declares the association lazy", 2, "count-queries,", False),
    ("other", "mysql", "@OneToMany(fetch = FetchType.LAZY) List<B> b;", "@OneToMany(fetch = FetchType.EAGER) List<B> b;", "Declares the association eager", 2, "count-queries,", False),
    ("other", "redis", "r.keys('*')", "r.scan('*')", "", 1, "engine-recipe,statistics", False),
)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = (F.col("p_partkey") % len(_CHANGES)).cast("int")
    of = lambda n: F.get(F.array(*[F.lit(c[n]) for c in _CHANGES]), k)
    return p.select("p_partkey", of(0).alias("category"), of(1).alias("engine"), of(2).alias("original"), of(3).alias("proposed"), F.lit(None).cast("string").alias("migration"))


def counted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = review.with_facts(_changes(spark, sf_dir), F.lit(0))
    return f.select("p_partkey", F.array_join("counted", "; ").alias("counted"), F.size("unmeasured").alias("unmeasured"), F.array_join("steps", ",").alias("steps"), "questionable")


#: Proposals that the gate judges, by key: original, proposed, category, assumption, and why each is held back.
_JUDGED = (
    ("Order.objects.filter(a=1).count()", " ", "n-plus-one", "", "no-op"),
    ("Order.objects.filter(a=1).only('a').exists()", "Order.objects.filter(a=1).exists()", "n-plus-one", "", "no-op"),
    ("if ((total(ids))):", "if total(ids):", "n-plus-one", "", "no-op"),
    ("Order.objects.get(id=1)", "Order.objects.zzqqxx(id=1).count()", "n-plus-one", "", "invented-symbol"),
    ("x = 1 + 2", "x = 3", "n-plus-one", "", "not-data-access"),
    ("Order.objects.get(id=1)", "Order.objects.get(id=1) or Order.objects.get(id=2)", "batching", "", "wrong-direction"),
    ("SELECT * FROM orders", "SELECT o_totalprice FROM orders LIMIT 3", "full-scan", "`cursor` is not used later.", "unsupported-assumption"),
    ("SELECT a, b FROM orders", "SELECT a FROM orders", "full-scan", "The result is not used.", None),
    ("SELECT a FROM orders", "SELECT a FROM orders WHERE b = 1", "full-scan", "", "unsupported-speculation"),
    ("CREATE INDEX i ON orders (a)", "DROP INDEX i", "redundant-index", "", None),
)


def judged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposals, as findings on each customer's view: counted, and judged against all files."""
    lib = table(spark, sf_dir, "region").select(_text("lib/r", F.col("r_regionkey"), ".py").alias("path"), _text("def ", F.lower("r_name"), "(): return Order.objects.get(id=1)").alias("content"))
    own = code_files(spark, sf_dir)
    files = own.select("path", "content").unionByName(lib)
    k = ((F.col("o_custkey") / 4).cast("int") % len(_JUDGED)).cast("int")
    of = lambda n: F.get(F.array(*[F.lit(c[n]) for c in _JUDGED]), k)
    rows = own.filter("o_custkey % 4 = 0").select(
        F.col("o_custkey").alias("id"), "path", "content", F.lit(5).alias("line"), F.lit(5).alias("end_line"), of(0).alias("original"), of(1).alias("proposed"), of(2).alias("category"), F.array(of(3)).alias("assumptions"), F.lit("postgres").alias("engine"), F.lit(None).cast("string").alias("migration"),
        F.lit("behavioural").alias("kind"), F.lit("verified").alias("grounding"), F.lit(3).alias("samples"), F.lit(1).alias("flagged"),
    )
    # After line 5 a view uses the cursor once for each order but the first.
    counted = review.with_facts(review.scoped(rows), F.col("loop_depth"))
    facts = counted.select("id", "counted", "questionable")
    judged = review.with_reasons(review.scoped(rows).join(facts.hint("merge"), "id"), files)
    return judged.select("id", F.coalesce("reason", F.lit("published")).alias("reason"), "severity")


def suppressed_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-back proposals by reason, in the order in which the reasons come up first."""
    held = judged_proposals(spark, sf_dir).filter("reason <> 'published'")
    return held.groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten findings that a report begins with."""
    g = review.grounded(findings(spark, sf_dir), code_files(spark, sf_dir)).withColumn("severity", F.when(F.col("id") % 3 == 0, "high").when(F.col("id") % 3 == 1, "low").otherwise("medium"))
    return g.orderBy(*review.report_order(), "id").limit(10).select("id", "kind", "severity", "grounding")


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses, one an order: fenced, with words around, cut off in a list, or no answer at all."""
    k = F.col("o_orderkey")
    item = lambda n: _text('{"title": "t', k, '", "original": "o{', F.lit(n).cast("string"), '}", "path": "p.py", "line": ', F.lit(n).cast("string"), ', "proposed": "q", "migration": "', F.when(k % 2 == 0, "omit").otherwise("CREATE INDEX i ON t (a)"), '"}')
    whole = _text('{"findings": [', item(1), ", ", item(2), "]}")
    raw = F.when(k % 5 == 0, whole).when(k % 5 == 1, _text("Here it is:\n```json\n", whole, "\n```\nDone.")).when(k % 5 == 2, _text('{"findings": [', item(1), ", ", '{"title": "cut')).when(k % 5 == 3, "nothing found").otherwise('{"findings": [{"title": "no place", "original": "x"}]}')
    found = review.plausible(review.answers(table(spark, sf_dir, "orders").select(k.alias("id"), raw.alias("raw"))))
    return found.select("id", "at", "title", "line", "migration", "repaired")


def engine_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What settles a claim on an engine, for suppliers as uses of engines and claims."""
    s = table(spark, sf_dir, "supplier")
    engines, claims = ("postgres", "mysql", "duckdb", "redis", "snowflake", "nonesuch"), ("n-plus-one", "missing-index", "redundant-index", "other")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names)).cast("int"))
    uses = s.select("s_suppkey", pick(engines).alias("engine"), pick(claims).alias("category"))
    return recipes.recipe_for(uses).select("s_suppkey", "plan", "measure", "claim", "replaces_plan", "generic")


#: Every engine, a name that is none, every category, and one that is none.
_ENGINES, _CATEGORIES = (*ENGINES, "nonesuch"), (*recipes.TESTS, "other")


def every_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What settles a claim of each category on each engine, and what speaks for it and against it, for parts as uses."""
    pick = lambda names, by: F.get(F.array(*[F.lit(n) for n in names]), (by % len(names)).cast("int"))
    k = F.col("p_partkey")
    uses = table(spark, sf_dir, "part").select("p_partkey", pick(_ENGINES, k).alias("engine"), pick(_CATEGORIES, F.floor(k / len(_ENGINES))).alias("category"))
    return recipes.claim_tests(recipes.recipe_for(uses)).select("p_partkey", "plan", "measure", "claim", "replaces_plan", "generic", "measures", "refutes")


def declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that parts declare, in SQL and as models, with the columns."""
    return ddl.table_facts(_schema_files(spark, sf_dir)).select("tab", F.array_join("cols", ",").alias("cols"))


def _schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sql = _text("-- CREATE TABLE no (x int)\nCREATE TABLE IF NOT EXISTS shop.`T", k, "` (id int, price decimal(10, 2) DEFAULT (1), note text DEFAULT 'a, b', PRIMARY KEY (id), UNIQUE KEY (price, note), CHECK (price > 0));\nCREATE UNIQUE INDEX CONCURRENTLY iu", k, ' ON "T', k, '" USING btree (price DESC, lower(note));')
    prisma = _text("model M", k, " {\n  id Int @id\n  a String\n  @@index([a, id])\n  @@unique([a])\n}\n")
    rails = _text("add_index :t", k, ", [:a, :b], unique: true\nadd_index 't", k, "', :c\n")
    alembic = _text("op.create_index('ix', 't", k, "', ['a', 'b'], unique=True)\nop.create_index('t", k, "', ['c'])\n")
    kind = k % 4
    return table(spark, sf_dir, "part").select(F.concat(F.when(kind == 0, "a/x").when(kind == 1, "b/y").when(kind == 2, "c/z").otherwise("d/w"), k.cast("string"), F.when(kind == 0, ".sql").when(kind == 1, ".prisma").when(kind == 2, ".rb").otherwise(".py")).alias("path"), F.when(kind == 0, sql).when(kind == 1, prisma).when(kind == 2, rails).otherwise(alembic).alias("content"))


def declared_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.index_facts(_schema_files(spark, sf_dir)).select("path", "source", "name", "tab", F.array_join("cols", "|").alias("cols"), "uniq")


def schema_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index proposals in text, one a part, against what the parts' own files declare."""
    files = _schema_files(spark, sf_dir)
    k = F.col("p_partkey")
    cols = F.when(k % 3 == 0, "price").when(k % 3 == 1, "a, id").otherwise("nope, id")
    texts = table(spark, sf_dir, "part").select(k.alias("id"), _text("CREATE INDEX ON ", F.when(k % 4 == 1, "M").otherwise("t"), k, " (", cols, ")").alias("text"))
    proposed = ddl.proposed_indexes(texts)
    declared = ddl.index_facts(files)
    found = ddl.index_advice(proposed, declared, ddl.table_facts(files))
    return found.select("id", F.col("duplicate_of").isNotNull().alias("duplicate"), F.col("covered_by").isNotNull().alias("covered"), F.array_join("unknown", ",").alias("unknown"), "known_table")


QUERIES = {
    f.__name__: f
    for f in (grounded_findings, reviewed_findings, counted_facts, judged_proposals, suppressed_by_reason, report_order, parsed_answers, engine_recipes, every_recipe, declared_tables, declared_indexes, schema_advice)
}
_BASE = "(SELECT o_custkey AS id, CAST(o_custkey / 4 AS INTEGER) AS j FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 4 = 0 GROUP BY 1)"
_GROUNDED = f"""(SELECT id, j, CASE WHEN j % 7 IN (1, 5) THEN 'rejected' WHEN j % 7 = 0 THEN 'verified' ELSE 'needs-verification' END AS grounding, CASE WHEN j % 7 <> 4 AND j % 5 IN (0, 3) THEN 'behavioural' ELSE 'equivalent' END AS kind,
    CASE WHEN j % 7 = 4 THEN 'partially-verified' ELSE list_extract(['contradicted', 'partially-verified', 'partially-verified', 'contradicted', 'machine-verified'], j % 5 + 1) END AS status FROM {_BASE} b)"""
_JUDGED_SQL = f"""(SELECT id, coalesce(CASE WHEN k = 6 AND n < 2 THEN NULL ELSE list_extract([{', '.join("NULL" if r is None else f"'{r}'" for *_, r in _JUDGED)}], k + 1) END, 'published') AS reason, CASE WHEN k IN (6, 7, 9) THEN 'high' ELSE 'low' END AS severity
    FROM (SELECT o_custkey AS id, CAST(CAST(o_custkey / 4 AS INTEGER) % {len(_JUDGED)} AS INTEGER) AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 4 = 0 GROUP BY 1))"""


def _quoted(v: str | bool | None) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _rows(rows: Iterable[tuple]) -> str:
    """Rows of a VALUES list."""
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


ORACLE_SQL = {
    "grounded_findings": f"""SELECT id, grounding, kind, CASE j % 7 WHEN 2 THEN 'line-outside-file' WHEN 3 THEN 'excerpt-not-there' WHEN 4 THEN 'original-not-there' WHEN 5 THEN 'evidence-file-missing' WHEN 6 THEN 'quote-not-there' ELSE '' END AS citations,
          concat_ws(',', CASE WHEN status = 'contradicted' THEN 'reclassified' WHEN j % 7 = 4 OR j % 5 = 2 THEN 'needs-review' END, CASE WHEN j % 7 <> 4 AND j % 5 = 1 THEN 'not-machine-checkable' END, CASE WHEN j % 3 = 0 THEN 'argument-incomplete' END,
            CASE WHEN j % 7 <> 4 AND j % 5 = 3 THEN 'index-without-evidence' END) AS analysis,
          CASE WHEN j % 7 IN (5, 6) THEN 0 ELSE 1 END AS evidence, CASE WHEN j % 7 IN (1, 2) THEN NULL ELSE 1 END AS loop_depth, CASE WHEN j % 7 IN (1, 2) THEN NULL ELSE 'C' || id || 'View.total' END AS symbol, CASE WHEN j % 7 IN (1, 2) THEN NULL ELSE 'request-handler' END AS trigger, status FROM {_GROUNDED} g""",
    "counted_facts": "SELECT p_partkey, c.* EXCLUDE (k) FROM part JOIN (VALUES " + ", ".join(f"({k}, {_quoted(c[4])}, {c[5]}, {_quoted(c[6].rstrip(','))}, {str(c[7]).lower()})" for k, c in enumerate(_CHANGES)) + f") c(k, counted, unmeasured, steps, questionable) ON p_partkey % {len(_CHANGES)} = k",
    "judged_proposals": f"SELECT id, reason, severity FROM {_JUDGED_SQL} j",
    "suppressed_by_reason": f"SELECT reason, count(*) AS n, min(id) AS first_id FROM {_JUDGED_SQL} j WHERE reason <> 'published' GROUP BY 1",
    "report_order": f"""SELECT id, kind, severity, grounding FROM (SELECT id, kind, CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, grounding FROM {_GROUNDED} g)
        ORDER BY kind = 'behavioural', CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE grounding WHEN 'verified' THEN 0 WHEN 'needs-verification' THEN 1 ELSE 2 END, id LIMIT 10""",
    "reviewed_findings": """SELECT c_custkey AS id, 'verified' AS grounding, CASE WHEN c_custkey % 2 = 0 THEN 'equivalent' ELSE 'behavioural' END AS kind,
        concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'argument-incomplete' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'index-without-evidence' END, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 IN (0, 4) THEN 'redundant-index' WHEN c_custkey % 3 > 0 AND c_custkey % 5 = 1 THEN 'covered-index' END) AS analysis,
        CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '1 fewer column(s); Caps the result at 9 row(s), unbounded before' END AS counted, 'speed,planner-choice,existing-index,write-cost' AS unmeasured, c_custkey % 2 = 0 AS questionable, CASE WHEN c_custkey % 2 = 0 THEN 'machine-verified' ELSE 'contradicted' END AS status FROM customer""",
    "parsed_answers": """SELECT o_orderkey AS id, CAST(n - 1 AS INTEGER) AS at, 't' || o_orderkey AS title, CAST(n AS INTEGER) AS line, CASE WHEN o_orderkey % 2 = 1 THEN 'CREATE INDEX i ON t (a)' END AS migration, o_orderkey % 5 = 2 AS repaired
        FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderkey % 5 IN (0, 1) OR o_orderkey % 5 = 2 AND n = 1""",
    "engine_recipes": f"""WITH u AS (SELECT s_suppkey, list_extract(['postgres', 'mysql', 'duckdb', 'redis', 'snowflake', 'nonesuch'], CAST(s_suppkey % 6 + 1 AS INTEGER)) AS engine, list_extract(['n-plus-one', 'missing-index', 'redundant-index', 'other'], CAST(s_suppkey % 4 + 1 AS INTEGER)) AS category FROM supplier),
        m AS (SELECT * FROM (VALUES {_rows((e, f) for f, names in FAMILIES for e in names.split())}) m(engine, family)), e AS (SELECT * FROM (VALUES {_rows((k, *v) for k, v in recipes.ENGINE_RECIPES.items())}) e(engine, plan, measure)),
        f AS (SELECT * FROM (VALUES {_rows((k, *v) for k, v in recipes.FAMILY_RECIPES.items())}) f(family, plan, measure)), c AS (SELECT * FROM (VALUES {_rows(recipes.CLAIMS)}) c(category, for_engine, for_family, claim, replaces)),
        t AS (SELECT u.*, coalesce(m.family, 'rdbms') AS family FROM u LEFT JOIN m ON m.engine = u.engine),
        b AS (SELECT s_suppkey, arg_min(struct_pack(claim, replaces), CASE WHEN for_engine IS NOT NULL THEN 0 WHEN for_family IS NOT NULL THEN 1 ELSE 2 END) AS c FROM t JOIN c ON c.category = t.category AND (c.for_engine = t.engine OR c.for_engine IS NULL AND (c.for_family IS NULL OR c.for_family = t.family)) GROUP BY 1)
        SELECT t.s_suppkey, CASE WHEN b.c.replaces THEN NULL ELSE coalesce(e.plan, f.plan) END AS plan, CASE WHEN b.c.replaces THEN NULL ELSE coalesce(e.measure, f.measure) END AS measure, b.c.claim AS claim, coalesce(b.c.replaces, false) AS replaces_plan, b.c IS NULL AS generic
        FROM t LEFT JOIN e ON e.engine = t.engine LEFT JOIN f ON f.family = t.family LEFT JOIN b ON b.s_suppkey = t.s_suppkey""",
    "declared_tables": "SELECT 't' || p_partkey AS tab, 'id,price,note' AS cols FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'm' || p_partkey, 'id,a' FROM part WHERE p_partkey % 4 = 1",
    "declared_indexes": """SELECT list_extract(['a/x', 'b/y', 'c/z', 'd/w'], f + 1) || k || list_extract(['.sql', '.prisma', '.rb', '.py'], f + 1) AS path, source, replace(name, '#', CAST(k AS VARCHAR)) AS name, replace(tab, '#', CAST(k AS VARCHAR)) AS tab, cols, uniq
        FROM (SELECT p_partkey AS k, p_partkey % 4 AS f FROM part) JOIN (VALUES (0, 'key', 'T#_primary', 'T#', 'id', true), (0, 'key', 'T#_unique', 'T#', 'price|note', true), (0, 'sql', 'iu#', 'T#', 'price|lower(note)', true), (1, 'prisma', 'M#_a_id', 'M#', 'a|id', false), (1, 'prisma', 'M#_a', 'M#', 'a', true),
          (2, 'rails', 't#_idx', 't#', 'a|b', true), (2, 'rails', 't#_idx', 't#', 'c', false), (3, 'alembic', 'ix', 't#', 'a|b', true), (3, 'alembic', 't#_idx', 't#', 'c', false)) v(g, source, name, tab, cols, uniq) ON f = g""",
    "schema_advice": """SELECT p_partkey AS id, p_partkey % 4 = 1 AND p_partkey % 3 = 1 AS duplicate, p_partkey % 4 = 0 AND p_partkey % 3 = 0 AS covered, CASE WHEN p_partkey % 4 = 0 THEN list_extract(['', 'a', 'nope'], p_partkey % 3 + 1) WHEN p_partkey % 4 = 1 THEN list_extract(['price', '', 'nope'], p_partkey % 3 + 1) ELSE '' END AS unknown, p_partkey % 4 < 2 AS known_table FROM part""",
}
# The same over all engines and categories, with what tells for and against each.
_list_sql = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_USES = f"SELECT p_partkey, {_list_sql(_ENGINES)}[CAST(p_partkey % {len(_ENGINES)} + 1 AS INTEGER)] AS engine, {_list_sql(_CATEGORIES)}[CAST(p_partkey // {len(_ENGINES)} % {len(_CATEGORIES)} + 1 AS INTEGER)] AS category FROM part"
_BY_USE = ORACLE_SQL["engine_recipes"].replace("s_suppkey", "p_partkey")
ORACLE_SQL["every_recipe"] = f"""SELECT r.*, x.measures, x.refutes FROM ({_BY_USE[: _BY_USE.index("u AS (")]}u AS ({_USES}),{_BY_USE[_BY_USE.index("FROM supplier),") + len("FROM supplier),") :]}) r
    JOIN ({_USES}) u USING (p_partkey) LEFT JOIN (VALUES {_rows((c, t[0], t[2]) for c, t in recipes.TESTS.items())}) x(category, measures, refutes) ON x.category = u.category"""
