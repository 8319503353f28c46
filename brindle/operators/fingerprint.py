"""A fingerprint of source files that does not depend on partitions, and tells which range of paths has changed.

Files are sorted by path over range partitions. Where a range of paths ends is told by the paths alone (one hash in RANGE begins a new one), so that an added or
removed file moves no other boundary. A range's digest is that of its files' digests in order; ranges are put together in the same way until one is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.running import running_total
from brindle.session import cut

#: Hex digits of a hash that must be zero for a path to begin a range: a range has 256 files on average, and hardly ever 5,000.
ZEROS = 2
#: Hex digits of a fingerprint.
DIGITS = 16


def file_digests(files: DataFrame) -> DataFrame:
    """(path, digest) of files (path, content): SHA-256 of the path and the content, so that a new name counts; a null content is empty. Rows that repeat a path stay."""
    return files.filter("path IS NOT NULL").select("path", F.sha2(F.concat("path", F.coalesce("content", F.lit(""))), 256).alias("digest"))


def ranges(digests: DataFrame, level: int = 0, zeros: int = ZEROS) -> DataFrame:
    """(path, digest, files) of each range of rows (path, digest, files): its first path, the digest of its digests in order, and how many files it has."""
    begins = F.sha2(F.concat(F.lit(f"{level}:"), "path"), 256).startswith("0" * zeros).cast("int")
    numbered = running_total(digests.withColumn("_begins", begins), [F.col("path"), F.col("digest")], "_begins", "_range")
    # Rows that repeat a path may lie on both sides of a boundary, each side with its own digest.
    row = F.array_sort(F.collect_list(F.struct("path", "digest")))
    grouped = numbered.groupBy("_range").agg(row.alias("_rows"), F.sum("files").alias("files"))
    return grouped.select(F.get("_rows", F.lit(0))["path"].alias("path"), F.sha2(F.array_join(F.transform("_rows", lambda r: r["digest"]), ""), 256).alias("digest"), "files")


def fingerprint(files: DataFrame, zeros: int = ZEROS) -> DataFrame:
    """One row (fingerprint, files): the first DIGITS digits of the root's digest; of no files, those of the digest of nothing."""
    rows, level = cut(file_digests(files).withColumn("files", F.lit(1).cast("long")), "digests"), 0
    while level == 0 or rows.count() > 1:
        rows = cut(ranges(rows, level, zeros), "ranges")
        level += 1
    digest = F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256))
    return rows.agg(F.left(digest, F.lit(DIGITS)).alias("fingerprint"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def changed_ranges(before: DataFrame, after: DataFrame, zeros: int = ZEROS) -> DataFrame:
    """(path, before, after): the ranges of paths whose digests differ between two states of the files, by their first path; null on the side that has no such range."""
    side = lambda f, n: ranges(file_digests(f).withColumn("files", F.lit(1).cast("long")), 0, zeros).select("path", F.col("digest").alias(n))
    both = side(before, "before").join(side(after, "after").hint("merge"), "path", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))
