"""What settles a claim on an engine: two small tables, the engine's row before its family's, and the claim's before both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.engines import FAMILIES, family_of

#: How a plan is shown, and how a statement is measured, by family; and by engine where it differs.
FAMILY_RECIPES = {
    "rdbms": ("EXPLAIN", "EXPLAIN ANALYZE"),
    "distributed-sql": ("EXPLAIN", "EXPLAIN ANALYZE"),
    "warehouse": ("EXPLAIN", "the query's profile"),
    "bigdata": ("EXPLAIN", "the job's stages"),
    "document": ("explain()", "explain('executionStats')"),
    "wide-column": ("TRACING ON", "TRACING ON"),
    "key-value": (None, "the slow log"),
    "graph": ("EXPLAIN", "PROFILE"),
    "search": ("the profile API", "the profile API"),
    "vector": (None, "recall and latency at a fixed k"),
    "timeseries": ("EXPLAIN", "EXPLAIN ANALYZE"),
    "object-embedded": ("EXPLAIN", None),
}
ENGINE_RECIPES = {
    "postgres": ("EXPLAIN (FORMAT JSON)", "EXPLAIN (ANALYZE, BUFFERS, FORMAT JSON)"),
    "mysql": (None, "EXPLAIN ANALYZE"),
    "mariadb": (None, "ANALYZE FORMAT=JSON"),
    "sqlite": ("EXPLAIN QUERY PLAN", ".timer on"),
    "mssql": ("SET SHOWPLAN_XML ON", "SET STATISTICS IO, TIME ON"),
    "oracle": ("EXPLAIN PLAN FOR", "DBMS_XPLAN.DISPLAY_CURSOR"),
    "db2": ("EXPLAIN PLAN FOR", "db2batch"),
    "yugabyte": (None, "EXPLAIN (ANALYZE, DIST)"),
    "spanner": ("execute-sql --query-mode=PLAN", "execute-sql --query-mode=PROFILE"),
    "vitess": ("VEXPLAIN PLAN", "VEXPLAIN ALL"),
    "snowflake": ("EXPLAIN USING TEXT", "GET_QUERY_OPERATOR_STATS(LAST_QUERY_ID())"),
    "bigquery": ("a dry run", "INFORMATION_SCHEMA.JOBS: bytes processed and slot time"),
    "redshift": (None, "SVL_QUERY_SUMMARY"),
    "synapse": (None, "sys.dm_pdw_request_steps"),
    "databricks": ("EXPLAIN FORMATTED", None),
    "athena": (None, "EXPLAIN ANALYZE"),
    "clickhouse": ("EXPLAIN indexes = 1", "system.query_log: read_rows and read_bytes"),
    "spark": ("EXPLAIN FORMATTED", "the metrics of the SQL tab"),
    "trino": (None, "EXPLAIN ANALYZE"),
    "impala": (None, "PROFILE"),
    "hbase": (None, "the metrics of the scan"),
    "couchdb": ("POST _explain", "execution_stats of _find"),
    "dynamodb": (None, "ReturnConsumedCapacity"),
    "cosmosdb": (None, "the request charge"),
    "scylla": (None, "system_traces.sessions"),
    "bigtable": (None, "Key Visualizer"),
    "redis": (None, "SLOWLOG GET"),
    "memcached": (None, "stats: hits and misses"),
    "etcd": (None, "the request duration metrics"),
    "ignite": ("EXPLAIN", "SYS.SQL_QUERIES_HISTORY"),
    "neptune": ("the explain endpoint", "the profile endpoint"),
    "arangodb": ("db._explain", "db._profileQuery"),
    "solr": ("debugQuery=true", "debug=timing"),
    "pgvector": ("EXPLAIN", "EXPLAIN (ANALYZE, BUFFERS), beside recall against an exact scan"),
    "timescaledb": (None, "EXPLAIN (ANALYZE, BUFFERS)"),
    "prometheus": (None, "the query log: samples read"),
    "druid": ("EXPLAIN PLAN FOR", "the query metrics"),
    "duckdb": (None, "EXPLAIN ANALYZE"),
    "rocksdb": (None, "the perf context"),
}
#: What settles a claim of a category: what is looked at, what speaks for it, and what against it.
TESTS = {
    "missing-index": ("the scan of the table, and rows read for each row returned", "an index scan takes the place of the full scan, and fewer rows are read", "the planner keeps the full scan, or as many rows are read"),
    "redundant-index": ("how often each of the two indexes is used", "the shorter one is never used on its own, over a whole business cycle", "a query uses the shorter one, or it enforces uniqueness"),
    "full-scan": ("the scan of the table", "only a part of the table is read", "the predicate keeps most rows, so that a full scan is right"),
    "n-plus-one": ("the statements of one unit of work", "their number no longer grows with the rows", "as many statements run, or they moved elsewhere"),
    "over-fetch": ("the width and the number of rows that travel", "fewer bytes are sent for the same result", "the columns left out are read later, one by one"),
    "unbounded-result": ("rows returned on the largest tenant", "no more rows come than are shown", "the caller needs them all"),
    "plan-cache-miss": ("plans made for each execution", "one plan is used again and again", "the texts still differ, or planning costs next to nothing"),
    "round-trip": ("the statements of one unit of work", "fewer statements, the same rows", "the same number, or another statement appears"),
    "inefficient-join": ("the order and the kind of the joins, and rows that go in and out", "fewer rows reach the join", "the planner had reordered it already"),
    "implicit-cast": ("whether the predicate is matched by an index", "the cast leaves the column, and the index is used", "no index is on the column"),
    "sort-in-memory": ("where the sort takes place, and what it needs", "rows come in order from an index, or the sort fits in memory", "the sort stays, or spills as before"),
    "batching": ("the statements of one unit of work, and how long its transaction is open", "fewer statements, and locks are held no longer", "one long transaction takes the place of many short ones"),
    "transaction-scope": ("how long locks are held, and who waits", "waits grow shorter", "the work needs the lock for as long"),
    "connection-handling": ("open connections, by state, over time", "fewer are open or idle at the same load", "as many are open, or callers wait for one"),
}


#: The instrument of a claim, whether it takes the place of a plan, and the engine or family that it is for; None: any.
CLAIMS = (
    ("n-plus-one", None, None, "count the statements of one request", True),
    ("round-trip", None, None, "count the statements of one request", True),
    ("batching", None, None, "count the statements of one request", True),
    ("redundant-index", "postgres", None, "pg_stat_user_indexes.idx_scan", True),
    ("redundant-index", "mysql", None, "sys.schema_unused_indexes", True),
    ("redundant-index", None, "rdbms", "the engine's index usage", True),
    ("connection-handling", "postgres", None, "pg_stat_activity by state", True),
    ("connection-handling", None, None, "open connections over time", True),
    ("transaction-scope", None, None, "lock waits and the age of transactions", True),
    ("plan-cache-miss", "postgres", None, "pg_stat_statements: plans and calls", False),
    ("plan-cache-miss", None, None, "compilations per second", False),
)


def _chosen(rows: Column, name: str) -> Column:
    """The first value of a field that is not null, in the order of an array of structs."""
    return F.get(F.filter(F.transform(rows, lambda r: r[name]), lambda v: v.isNotNull()), F.lit(0))


def recipe_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables: (engine, family, plan, measure) and (category, for_engine, for_family, claim, replaces_plan)."""
    spark = df.sparkSession
    rows = [(None, f, *FAMILY_RECIPES[f]) for f, _ in FAMILIES] + [(e, None, *r) for e, r in ENGINE_RECIPES.items()]
    return spark.createDataFrame(rows, "engine string, family string, plan string, measure string"), spark.createDataFrame(list(CLAIMS), "category string, for_engine string, for_family string, claim string, replaces_plan boolean")


def recipe_for(uses: DataFrame) -> DataFrame:
    """uses (engine, category, ...) with plan, measure, claim, replaces_plan and generic.

    Field by field an engine's own value goes before its family's; a claim's instrument is the engine's, else the family's, else
    anyone's, and where it replaces the plan, neither plan nor measure is given. generic: no instrument is for this claim. Both tables are
    dimensions of a few rows.
    """
    own, claims = recipe_tables(uses)
    by_engine = own.filter("engine IS NOT NULL").select(F.col("engine").alias("_e"), F.col("plan").alias("_plan_e"), F.col("measure").alias("_measure_e"))
    by_family = own.filter("family IS NOT NULL").select(F.col("family").alias("_f"), F.col("plan").alias("_plan_f"), F.col("measure").alias("_measure_f"))
    rank = F.when(F.col("for_engine").isNotNull(), 0).when(F.col("for_family").isNotNull(), 1).otherwise(2)
    overlays = claims.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "for_engine", "for_family", "claim", "replaces_plan"))).alias("_claims"))
    told = uses.withColumn("_family", family_of(F.col("engine")))
    told = told.join(F.broadcast(by_engine), told["engine"] == F.col("_e"), "left").join(F.broadcast(by_family), F.col("_family") == F.col("_f"), "left").join(F.broadcast(overlays), "category", "left")
    fits = F.filter("_claims", lambda c: c["for_engine"].eqNullSafe(F.col("engine")) | (c["for_engine"].isNull() & (c["for_family"].isNull() | (c["for_family"] == F.col("_family")))))
    told = told.select(*uses.columns, F.coalesce("_plan_e", "_plan_f").alias("_plan"), F.coalesce("_measure_e", "_measure_f").alias("_measure"), fits.alias("_fits"))
    claim, instead = _chosen(F.col("_fits"), "claim"), F.coalesce(_chosen(F.col("_fits"), "replaces_plan"), F.lit(False))
    return told.select(*uses.columns, F.when(~instead, F.col("_plan")).alias("plan"), F.when(~instead, F.col("_measure")).alias("measure"), claim.alias("claim"), instead.alias("replaces_plan"), claim.isNull().alias("generic"))


def claim_tests(uses: DataFrame) -> DataFrame:
    """uses (category, ...) with measures, confirms and refutes: what is looked at to settle a claim of the category, and what speaks for and against it; null for any other."""
    of = lambda k: F.coalesce(*[F.when(F.col("category") == c, F.lit(t[k])) for c, t in TESTS.items()])
    return uses.select("*", of(0).alias("measures"), of(1).alias("confirms"), of(2).alias("refutes"))


#: How the statements that code runs are counted, by library.
COUNTERS = {
    "django": "CaptureQueriesContext(connection)",
    "activerecord": "ActiveSupport::Notifications on sql.active_record",
    "sqlalchemy": "an event listener on before_cursor_execute",
    "prisma": "a client with log: ['query']",
    "sequelize": "the logging option",
    "typeorm": "the logging option of the data source",
    "gorm": "a logger at level Info",
    "hibernate": "Statistics.getPrepareStatementCount()",
    "efcore": "LogTo with the command category",
    "mongoose": "mongoose.set('debug', true)",
    "pymongo": "a CommandListener",
}


def counter_of(dialect: Column) -> Column:
    """What counts the statements of a library's calls; for any other, the database's own log."""
    return F.coalesce(*[F.when(dialect == d, F.lit(c)) for d, c in COUNTERS.items()], F.lit("the database's statement log"))
