"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First path segments that are pages of a forge, not owners.
RESERVED = ("settings", "notifications", "explore", "marketplace", "topics", "login", "search", "dashboard", "groups", "users")


def page_url(url: Column) -> Column:
    """struct(scheme, host, path, section, page): the parts of a web address; page is the number its path ends in, null without one."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    return F.struct(
        F.regexp_extract(url, r"^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1).alias("host"),
        path.alias("path"),
        F.regexp_extract(path, r"^/([^/]*)", 1).alias("section"),
        F.nullif(F.regexp_extract(path, r"/([0-9]+)/?$", 1), F.lit("")).try_cast("long").alias("page"),
    )


def repository(address: Column) -> Column:
    """struct(forge, host, owner, name, ref, pull_request) of owner/name, https and scp-style addresses; owner is null where there is none."""
    trimmed = F.regexp_replace(F.trim(address), r"(\.git)?/?$", "")
    scp = trimmed.rlike(r"^git@[^:]+:.+")
    host = F.lower(F.when(scp, F.regexp_extract(trimmed, r"^git@([^:]+):", 1)).when(trimmed.rlike("^https?://"), F.regexp_extract(trimmed, r"^https?://([^/]+)", 1)).otherwise("github.com"))
    path = F.when(scp, F.regexp_extract(trimmed, r"^git@[^:]+:(.+)$", 1)).when(trimmed.rlike("^https?://"), F.regexp_extract(trimmed, r"^https?://[^/]+/(.*)$", 1)).otherwise(trimmed)
    gitlab = F.contains(host, F.lit("gitlab"))
    repo = F.regexp_replace(path, r"/-/.*$", "")
    parts = F.split(repo, "/")
    ok = (F.size(parts) >= 2) & ~F.get(parts, F.lit(0)).isin(*RESERVED)
    owner = F.when(gitlab, F.regexp_extract(repo, r"^(.+)/[^/]+$", 1)).otherwise(F.get(parts, F.lit(0)))
    name = F.when(gitlab, F.element_at(parts, -1)).otherwise(F.get(parts, F.lit(1)))
    return F.struct(
        F.when(gitlab, "gitlab").otherwise("github").alias("forge"),
        host.alias("host"),
        F.when(ok, owner).alias("owner"),
        F.when(ok, name).alias("name"),
        F.nullif(F.regexp_extract(path, r"/tree/([^/]+)", 1), F.lit("")).alias("ref"),
        F.nullif(F.regexp_extract(path, r"/(?:pull|merge_requests)/([0-9]+)", 1), F.lit("")).try_cast("int").alias("pull_request"),
    )
