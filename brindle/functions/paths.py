"""What a path says about a file: whether it is read, and what its code is for."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension or name, and path patterns. All patterns are matched without regard to case.
MAX_FILE_BYTES = 512 * 1024
SKIPPED_DIRS = ("node_modules/", "vendor/", "dist/", "build/", "target/", ".git/", "venv/", ".venv/", "site-packages/", "__pycache__/", "coverage/", ".next/", ".nuxt/", "bower_components/", "third_party/", "Pods/")
SKIPPED_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "avif", "mp4", "mov", "mp3", "wav", "pdf", "zip", "gz", "tar", "bz2", "7z", "rar", "woff", "woff2", "ttf", "eot", "otf", "so", "dylib", "dll", "exe", "bin", "class", "jar", "wasm", "pyc", "o", "a", "lock", "map", "min.js", "snap",
)
LOCKFILES = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|go\.sum|Cargo\.lock)$"
PROSE_EXTENSIONS = ("md", "markdown", "mdx", "rst", "txt", "adoc", "asciidoc", "org", "tex", "po", "pot", "mo", "csv", "tsv", "log", "lock", "svg")
STYLE_EXTENSIONS = ("css", "scss", "sass", "less", "styl", "stylus", "pcss", "postcss")
BUILD_SCRIPTS = ("mvnw", "gradlew", "gradle", "configure", "bootstrap")
SHELL_EXTENSIONS = ("bat", "cmd", "ps1", "sh", "bash", "zsh", "fish", "nu")
ALWAYS_SCRIPTS = ("bat", "cmd", "ps1")
EXTENSIONLESS_CODE = ("rakefile", "gemfile")
LOCALE_PATH = r"(^|/)(?:locales?|i18n|intl|translations?|lang|messages)/|(^|/)LC_MESSAGES/"
SCHEMA_PATHS = (
    r"schema\.prisma$", r"(^|/)migrations?/", r"(^|/)db/", r"(^|/)models?/", r"(^|/)entities/", r"\.(?:sql|ddl|hql|cql|psql)$", r"(^|/)(schema|structure)\.(sql|rb|py|ts|js|json|graphql)$",
    r"alembic|flyway|liquibase|goose|knexfile|sequelize|typeorm", r"(^|/)dbt_project\.ya?ml$", r"(^|/)models?/.*\.ya?ml$", r"index(?:es)?\.(?:sql|json|ya?ml)$",
)
MIGRATION_TOOL_PATH = r"(^|/)alembic/|(^|/)db/migrate/|(^|/)liquibase/|(^|/)flyway/|(^|/)goose/"
SEED_PATH = r"(^|/)seeds?/|(^|/)fixtures?/|(^|/)factories/"
DDL_FILE = r"(^|/)(?:schema|structure|data|seed|seeds|fixtures|initial|init)[\w.-]*\.(?:sql|ddl|psql|hql|cql)$"
DDL_DIR = r"(^|/)(?:db|database|sql|ddl)/(?:[^/]+/)?[\w.-]+\.(?:sql|ddl|psql)$"
SCHEMA_FILE = r"\.prisma$|(^|/)(?:schema|structure)\.(?:rb|py|ts|js|json|graphql|graphqls|hcl)$"
MIGRATION_ROOT = r"^[\w.-]*migrat(?:e|ion)[\w.-]*/"
MIGRATION_DIR = r"(^|/)[\w.-]*migrat(?:e|ion)[\w.-]*/"
VERSIONED_FILE = r"(^|/)(?:v?\d[\w.-]*)\.(?:go|rb|py|sql|ts|js|mjs|php|cs|java|kt|ex)$"
TEST_PATH = r"(^|/)tests?/|(^|/)spec/|[._-]test\.|[._-]spec\.|_tests?\.py$|Test\.(?:java|kt|cs|scala)$|Tests\.(?:java|kt|cs)$"
HANDLER_PATH = r"(^|/)(?:controllers?|handlers?|resolvers?|endpoints?|routes?|views?|api)/|(^|/)views\.py$"
JOB_PATH = r"(^|/)(?:tasks|jobs|workers|commands|consumers|crons?|schedulers?)/"
# Ends of names, with regard to case.
HANDLER_SYMBOL = r"(?:View|Controller|Handler|Resource|Resolver|Endpoint|Route|Api|Serializer)$"
JOB_SYMBOL = r"Command$|Job$|Task$|Worker$|Consumer$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the lower-cased path; the whole path if it has none."""
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def _like(path: Column, pattern: str) -> Column:
    return path.rlike("(?i)" + pattern)


def is_scannable(path: Column, size: Column) -> Column:
    vendored = reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(d)) for d in SKIPPED_DIRS])
    return (size <= MAX_FILE_BYTES) & ~vendored & ~_like(path, LOCKFILES) & ~extension(path).isin(*SKIPPED_EXTENSIONS)


def scannable(path: str, size: int) -> bool:
    """is_scannable of one path."""
    lower = path.lower()
    return size <= MAX_FILE_BYTES and not any(d in lower for d in SKIPPED_DIRS) and re.search(LOCKFILES, path, re.IGNORECASE) is None and lower.rsplit(".", 1)[-1] not in SKIPPED_EXTENSIONS


def is_build_script(path: Column) -> Column:
    name, ext = base_name(path), extension(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return name.isin(*BUILD_SCRIPTS) | (F.contains(name, F.lit(".")) & (ext.isin(*ALWAYS_SCRIPTS) | (ext.isin(*SHELL_EXTENSIONS) & stem.isin(*BUILD_SCRIPTS))))


def is_locale(path: Column) -> Column:
    return _like(path, LOCALE_PATH)


def is_prose(path: Column) -> Column:
    """Files that hold no query: prose, stylesheets, build scripts, translations, and names without an extension."""
    name, ext = base_name(path), extension(path)
    bare = (name != "") & ~F.contains(name, F.lit(".")) & ~name.isin(*EXTENSIONLESS_CODE)
    return ext.isin(*PROSE_EXTENSIONS, *STYLE_EXTENSIONS) | is_build_script(path) | is_locale(path) | bare


def is_schema_file(path: Column) -> Column:
    return _like(path, "|".join(f"(?:{p})" for p in SCHEMA_PATHS))


def path_kinds(path: Column) -> dict[str, Column]:
    """Whether a path is that of a migration, a test, a request handler or a job."""
    migration = _like(path, MIGRATION_TOOL_PATH) | _like(path, SEED_PATH) | _like(path, DDL_FILE) | _like(path, DDL_DIR) | _like(path, SCHEMA_FILE) | _like(path, MIGRATION_ROOT) | (_like(path, MIGRATION_DIR) & _like(path, VERSIONED_FILE))
    return {"migration": migration, "test": _like(path, TEST_PATH), "handler": _like(path, HANDLER_PATH), "job": _like(path, JOB_PATH)}


def trigger_of(kinds: dict[str, Column], symbol: Column, has_handler_decorator: Column) -> Column:
    """What reaches the code, first match first: migration, test, request-handler, job, unknown."""
    named = F.coalesce(symbol, F.lit(""))
    outermost = F.element_at(F.split(named, r"\."), 1)
    handler = has_handler_decorator | outermost.rlike(HANDLER_SYMBOL) | named.rlike(HANDLER_SYMBOL) | kinds["handler"]
    return (
        F.when(kinds["migration"], "migration")
        .when(kinds["test"], "test")
        .when(handler, "request-handler")
        .when(kinds["job"] | outermost.rlike(JOB_SYMBOL), "job")
        .otherwise("unknown")
    )


def trigger(path: Column, symbol: Column, has_handler_decorator: Column) -> Column:
    return trigger_of(path_kinds(path), symbol, has_handler_decorator)
