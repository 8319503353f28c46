"""Queries over files: the rows of documents, pages and customer seen as paths with a size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import paths as P
from brindle.functions import text as X
from brindle.functions.urls import page_url, repository
from brindle.tables import table

#: Folders and extensions that documents are given, by their id.
FOLDERS = ("src/app", "app/controllers", "db/migrate", "tests/unit", "config/locales", "docs", "jobs", "node_modules/x", "services/migrations", "src/views")
EXTENSIONS = ("py", "ts", "sql", "md", "yml", "scss", "rb", "sh", "min.js", "lock", "java", "png")


def _quoted(items: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, text, lang, source): a file for each document."""
    d = table(spark, sf_dir, "documents")
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.floor(F.col("doc_id") / 7) % len(EXTENSIONS) + 1).cast("int"))
    return d.select("doc_id", F.concat(folder, F.lit("/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), (F.col("n_chars") * 40).alias("size"), "text", "lang", "source")


FILES = f"""(SELECT doc_id, list_extract([{_quoted(FOLDERS)}], CAST(doc_id % {len(FOLDERS)} + 1 AS INTEGER)) || '/' || source || '_' || doc_id || '.'
  || list_extract([{_quoted(EXTENSIONS)}], CAST((doc_id // 7) % {len(EXTENSIONS)} + 1 AS INTEGER)) AS path, n_chars * 40 AS size, text, lang, source FROM documents)"""
_EXT = "list_extract(string_split(lower(path), '.'), -1)"
_NAME = "list_extract(string_split(lower(path), '/'), -1)"
_SCRIPT = f"({_NAME} IN ({_quoted(P.BUILD_SCRIPTS)}) OR (contains({_NAME}, '.') AND ({_EXT} IN ({_quoted(P.ALWAYS_SCRIPTS)}) OR ({_EXT} IN ({_quoted(P.SHELL_EXTENSIONS)}) AND regexp_replace({_NAME}, '\\.[^.]*$', '') IN ({_quoted(P.BUILD_SCRIPTS)})))))"
_LOCALE = f"regexp_matches(path, '{P.LOCALE_PATH}', 'i')"
_PROSE = f"({_EXT} IN ({_quoted(P.PROSE_EXTENSIONS + P.STYLE_EXTENSIONS)}) OR {_SCRIPT} OR {_LOCALE} OR ({_NAME} <> '' AND NOT contains({_NAME}, '.') AND {_NAME} NOT IN ({_quoted(P.EXTENSIONLESS_CODE)})))"
_SCANNABLE = f"(size <= {P.MAX_FILE_BYTES} AND NOT ({' OR '.join(f'contains(lower(path), {_quoted((d,))})' for d in P.SKIPPED_DIRS)}) AND NOT regexp_matches(path, '{P.LOCKFILES}', 'i') AND {_EXT} NOT IN ({_quoted(P.SKIPPED_EXTENSIONS)}))"


def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(P.is_scannable(F.col("path"), F.col("size"))).select("doc_id", "path", "size")


def prose_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select("doc_id", P.is_prose(p).alias("prose"), P.is_build_script(p).alias("script"), P.is_locale(p).alias("locale"), P.is_schema_file(p).alias("schema"))


def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.groupBy(P.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(P.is_scannable(F.col("path"), F.col("size")).cast("long")).alias("scannable"))


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_url(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path", "u.section", "u.page")


def repository_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    owner = F.concat(F.lit("team"), (F.col("s_nationkey")).cast("string"))
    name = F.concat(F.lit("repo"), F.col("s_suppkey").cast("string"))
    k = F.col("s_suppkey") % 5
    address = (
        F.when(k == 0, F.concat(owner, F.lit("/"), name))
        .when(k == 1, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/pull/"), F.col("s_suppkey").cast("string")))
        .when(k == 2, F.concat(F.lit("git@github.com:"), owner, F.lit("/"), name, F.lit(".git")))
        .when(k == 3, F.concat(F.lit("https://gitlab.com/group/"), owner, F.lit("/"), name, F.lit("/-/tree/main")))
        .otherwise(F.concat(F.lit("https://github.com/explore/"), name))
    )
    return s.select("s_suppkey", repository(address).alias("r")).select("s_suppkey", "r.forge", "r.host", "r.owner", "r.name", "r.ref", "r.pull_request")


_REPOSITORIES = """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 3 THEN 'gitlab' ELSE 'github' END AS forge, CASE WHEN s_suppkey % 5 = 3 THEN 'gitlab.com' ELSE 'github.com' END AS host,
  CASE s_suppkey % 5 WHEN 4 THEN NULL WHEN 3 THEN 'group/team' || s_nationkey ELSE 'team' || s_nationkey END AS owner, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'repo' || s_suppkey END AS name,
  CASE WHEN s_suppkey % 5 = 3 THEN 'main' END AS ref, CASE WHEN s_suppkey % 5 = 1 THEN CAST(s_suppkey AS INTEGER) END AS pull_request FROM supplier"""


def trigger_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.when(F.col("doc_id") % 11 == 0, F.lit("OrderController.list")).when(F.col("doc_id") % 13 == 0, F.lit("ImportJob")).otherwise(F.lit(None))
    return files(spark, sf_dir).select("doc_id", P.trigger(F.col("path"), symbol, F.col("doc_id") % 17 == 0).alias("trigger"))


_TRIGGER = f"""SELECT doc_id, CASE WHEN regexp_matches(path, '{P.MIGRATION_TOOL_PATH}', 'i') OR regexp_matches(path, '{P.SEED_PATH}', 'i') OR regexp_matches(path, '{P.DDL_FILE}', 'i') OR regexp_matches(path, '{P.DDL_DIR}', 'i')
    OR regexp_matches(path, '{P.SCHEMA_FILE}', 'i') OR regexp_matches(path, '{P.MIGRATION_ROOT}', 'i') OR (regexp_matches(path, '{P.MIGRATION_DIR}', 'i') AND regexp_matches(path, '{P.VERSIONED_FILE}', 'i')) THEN 'migration'
  WHEN regexp_matches(path, '{P.TEST_PATH}', 'i') THEN 'test'
  WHEN doc_id % 17 = 0 OR doc_id % 11 = 0 OR regexp_matches(path, '{P.HANDLER_PATH}', 'i') THEN 'request-handler'
  WHEN regexp_matches(path, '{P.JOB_PATH}', 'i') OR (doc_id % 13 = 0) THEN 'job' ELSE 'unknown' END AS trigger FROM {FILES} f"""


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every page holds its title loosely, as it is and with words that are not there."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", X.contains_loosely(F.col("html"), F.col("title")).alias("as_is"), X.contains_loosely(F.col("html"), F.concat(F.col("title"), F.lit(" and something that is not in the page at all"))).alias("longer"), F.length("title").alias("asked"))


def _plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[\"''`]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def _loosely(h: str, q: str) -> str:
    starts = f"range(0, length({q}) - {X.WINDOW_CHARS} + 1, {X.WINDOW_CHARS})"
    return f"({q} = '' OR contains({h}, {q}) OR CASE WHEN length({q}) >= {X.WINDOW_CHARS} THEN len(list_filter({starts}, lambda i: contains({h}, substring({q}, CAST(i + 1 AS INTEGER), {X.WINDOW_CHARS})))) >= {X.CONTAINED_SHARE} * len({starts}) ELSE false END)"


_CITATIONS = f"""WITH p AS (SELECT page_id, {_plain('html')} AS h, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
 q AS (SELECT page_id, h, t, {_plain('t')} AS a, {_plain("t || ' and something that is not in the page at all'")} AS b FROM p)
SELECT page_id, {_loosely('h', 'a')} AS as_is, {_loosely('h', 'b')} AS longer, CAST(length(t) AS INTEGER) AS asked FROM q"""


def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.missing_dimensions(F.col("text")), ",").alias("missing"), X.estimate_tokens(F.col("text")).alias("tokens"))


_DIMENSIONS = f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN NOT regexp_matches(text, '{p}') THEN '{n}' END" for n, p in X.DIMENSIONS)}], lambda x: x IS NOT NULL), ',') AS missing,
 CAST(ceil(length(text) / {X.TOKEN_CHARS}) AS BIGINT) AS tokens FROM documents"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines around the middle of every document."""
    d = table(spark, sf_dir, "documents").withColumn("at", F.floor(F.length("text") / 2).cast("int"))
    line = X.line_of(F.col("text"), F.col("at"))
    return d.select("doc_id", line.cast("long").alias("line"), F.md5(X.slice_lines(F.col("text"), line - 1, line + 1)).alias("excerpt"))


_EXCERPTS = r"""WITH d AS (SELECT doc_id, text, length(text) // 2 AS pos FROM documents),
 l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, CAST(length(substring(text, 1, pos)) - length(replace(substring(text, 1, pos), chr(10), '')) + 1 AS BIGINT) AS line FROM d)
SELECT doc_id, line, md5(array_to_string(list_slice(lines, greatest(1, line - 1), least(len(lines), line + 1)), chr(10))) AS excerpt FROM l"""


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: files, those that are read, and those that hold no query though they are read."""
    f = files(spark, sf_dir)
    read, prose = P.is_scannable(F.col("path"), F.col("size")), P.is_prose(F.col("path"))
    return f.groupBy("source").agg(F.count("*").alias("files"), F.sum(read.cast("long")).alias("read"), F.sum((read & prose).cast("long")).alias("prose"), F.sum(F.greatest(F.col("size") - P.MAX_FILE_BYTES, F.lit(0))).alias("oversize"))


QUERIES = {
    "scannable_files": scannable_files, "prose_filter": prose_filter, "ext_histogram": ext_histogram, "url_parse": url_parse, "repository_addresses": repository_addresses, "trigger_by_path": trigger_by_path,
    "citation_check": citation_check, "dimension_check": dimension_check, "excerpts": excerpts, "coverage_stats": coverage_stats,
}
ORACLE_SQL = {
    "scannable_files": f"SELECT doc_id, path, size FROM {FILES} f WHERE {_SCANNABLE}",
    "prose_filter": f"SELECT doc_id, {_PROSE} AS prose, {_SCRIPT} AS script, {_LOCALE} AS locale, regexp_matches(lower(path), '{'|'.join(f'(?:{p})' for p in P.SCHEMA_PATHS)}') AS schema FROM {FILES} f",
    "ext_histogram": f"SELECT {_EXT} AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN {_SCANNABLE} THEN 1 ELSE 0 END) AS BIGINT) AS scannable FROM {FILES} f GROUP BY 1",
    "url_parse": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages)
        SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, path, regexp_extract(path, '^/([^/]*)', 1) AS section, try_cast(nullif(regexp_extract(path, '/([0-9]+)/?$', 1), '') AS BIGINT) AS page FROM p""",
    "repository_addresses": _REPOSITORIES,
    "trigger_by_path": _TRIGGER,
    "citation_check": _CITATIONS,
    "dimension_check": _DIMENSIONS,
    "excerpts": _EXCERPTS,
    "coverage_stats": f"SELECT source, count(*) AS files, CAST(sum(CASE WHEN {_SCANNABLE} THEN 1 ELSE 0 END) AS BIGINT) AS read, CAST(sum(CASE WHEN {_SCANNABLE} AND {_PROSE} THEN 1 ELSE 0 END) AS BIGINT) AS prose, CAST(sum(greatest(size - {P.MAX_FILE_BYTES}, 0)) AS BIGINT) AS oversize FROM {FILES} f GROUP BY source",
}
