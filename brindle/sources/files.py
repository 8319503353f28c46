"""Source files as rows (path, size, content): folders, archives, and what of them changed."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.paths import MAX_FILE_BYTES, is_scannable, scannable

#: Bytes of text that one archive may unpack to.
MAX_ARCHIVE_BYTES = 256 * 1024 * 1024


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Scannable files below a folder. Sizes and names are filtered before any content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= MAX_FILE_BYTES)
    root = folder.rstrip("/").replace("file://", "")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?{root.lstrip('/')}/", "")
    named = found.select(relative.alias("path"), F.col("length").alias("size"), "content")
    return named.filter(is_scannable(F.col("path"), F.col("size"))).withColumn("content", F.decode("content", "UTF-8"))


def from_archives(spark: SparkSession, glob: str, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """(archive, path, size, content, cut, reason) of the regular files in tar archives, packed or not, without their root folder. Files that are not scanned are never unpacked, and use up nothing of max_bytes.

    An archive is unpacked by one task, member by member (Spark hands over archives of up to 2 GB); what lies beyond max_bytes of it is left
    out and flagged as cut. An archive that can't be read, or breaks off, has a row without a path that gives the reason, after what was read of it.
    """

    def row(name: str, path: str | None, size: int, text: str | None, cut: bool, reason: str | None) -> pd.DataFrame:
        return pd.DataFrame({"archive": [name], "path": [path], "size": [size], "content": [text], "cut": [cut], "reason": [reason]})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                total = 0
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                        for m in tar:
                            path = m.name.split("/", 1)[-1] if "/" in m.name else m.name
                            if not m.isfile() or not scannable(path, m.size):
                                continue
                            total += m.size
                            keep = total <= max_bytes
                            text = tar.extractfile(m).read().decode("utf-8", "replace") if keep else None
                            yield row(name, path, m.size, text, not keep, None)
                except (tarfile.TarError, EOFError, OSError) as error:
                    yield row(name, None, len(raw), None, False, f"{type(error).__name__}: {error}")

    raw = spark.read.format("binaryFile").load(glob).select("path", "content")
    return raw.mapInPandas(unpack, "archive string, path string, size long, content string, cut boolean, reason string")


def listed(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """(path, size, truncated): the first `most` files below a folder by path, none of them read; truncated on every row if there are more."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    first = found.orderBy("path").limit(most + 1)
    return first.join(F.broadcast(first.agg((F.count("*") > most).alias("truncated"))), F.lit(True)).orderBy("path").limit(most)


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, reason): the files below a folder that from_folder does not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    reason = F.when(F.col("size") > MAX_FILE_BYTES, "oversize").when(~is_scannable(F.col("path"), F.col("size")), "not-scanned")
    return found.withColumn("reason", reason).filter("reason IS NOT NULL")


def changed(files: DataFrame, *paths: DataFrame) -> DataFrame:
    """The files whose path is in any of the tables of changed paths (path, status); removed ones don't count."""
    every = None
    for p in paths:
        kept = p.filter("status <> 'removed'").select("path")
        every = kept if every is None else every.union(kept)
    return files.join(every.distinct(), "path", "left_semi")
