"""A stored table of one row a key, kept up to date by batches of a stream.

Rows are dealt to a fixed number of buckets by key. A batch rewrites the buckets it touches into folders of its own, and last of all a manifest that says which folder
each bucket is in: whoever reads sees the table before the batch or after it, and a batch that breaks off, or runs twice, leaves no trace.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_BUCKET = "_bucket"


class KeyedTable:
    """One row for each key (null keys are keys too): the one that is last by `order`, and by its other columns where that ties.

    buckets bounds what the manifest and the driver hold; at scale a bucket should fit a task's disk, not its memory.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), schema, keys, order, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """{"version", "batch", "buckets": {bucket: folder}} of the newest version; version 0 of an empty table."""
        fs, at = self._files(), self._path("manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        whole = [n for n in names if n.endswith(".json")]
        if not whole:
            return {"version": 0, "batch": None, "buckets": {}}
        stream = fs.open(self._path(f"manifest/{whole[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        fs, part = self._files(), self._path(f"manifest/{uuid.uuid4().hex}.part")
        stream = fs.create(part)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if not fs.rename(part, self._path(f"manifest/{manifest['version']:012d}.json")):
            raise OSError("another batch has written this version")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (*self.keys, self.order)]
        last = F.max(F.struct(self.order, *rest)).alias("_last")
        return rows.groupBy(_BUCKET, *self.keys).agg(last).select(_BUCKET, *self.keys, "_last.*").select(_BUCKET, *self.schema.names)

    def upsert(self, batch: DataFrame, number: int | None = None) -> list[int]:
        """Takes in a batch, and returns the buckets that it rewrote. number: the batch's own, where it has one; one that the table has already is left out."""
        before = self.manifest()
        if number is not None and before["batch"] is not None and number <= before["batch"]:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(self.schema.names).withColumn(_BUCKET, bucket)
        touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # at most `buckets` numbers
        version, folders = before["version"] + 1, dict(before["buckets"])
        if touched:
            name = f"data/{version}-{uuid.uuid4().hex}"
            merged = self._newest(self._read({b: f for b, f in folders.items() if int(b) in set(touched)}).unionByName(rows))
            merged.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
            folders |= {str(b): name for b in touched}
        self._swap({"version": version, "batch": number if number is not None else before["batch"], "buckets": folders})
        return touched

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], StructType(self.schema.fields)).withColumn(_BUCKET, F.lit(0))
        every = None
        by_folder: dict[str, list[int]] = {}
        for b, f in folders.items():
            by_folder.setdefault(f, []).append(int(b))
        for f, numbers in sorted(by_folder.items()):
            paths = [f"{self.folder}/{f}/{_BUCKET}={b}" for b in numbers]
            rows = self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/{f}").parquet(*paths).select(*self.schema.names, F.col(_BUCKET).cast("int").alias(_BUCKET))
            every = rows if every is None else every.unionByName(rows)
        return every

    def read(self) -> DataFrame:
        """The table as its newest manifest says."""
        return self._read(self.manifest()["buckets"]).drop(_BUCKET)

    def live(self, at: Column, ttl: int) -> DataFrame:
        """The rows whose order, a time in seconds, is less than ttl before at."""
        return self.read().filter(at - F.col(self.order) < ttl)

    def newest(self, by: list[str], most: int, at: Column | None = None, ttl: int = 0) -> DataFrame:
        """Of each value of `by` the `most` rows that are last by order, of those that live."""
        rows = self.read() if at is None else self.live(at, ttl)
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(self.order).desc(), *self.keys))).filter(F.col("_n") <= most).drop("_n")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in a stream batch by batch."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.upsert(rows, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
