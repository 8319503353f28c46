"""Streams: idle sessions, entries that live for a time, and incremental scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, name: str = "events.parquet") -> DataFrame:
    """A table's files in a folder as a stream, one file a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)


def idle_sessions(events: DataFrame, key: str = "user_id", time: str = "ts", idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, events) of sessions that end after an idle time; events later than the watermark are dropped, and state is kept no longer."""
    w = F.session_window(time, idle)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def first_within(events: DataFrame, keys: list[str], time: str, ttl: str = "60 minutes") -> DataFrame:
    """The first event of each key within its time to live; repeats in that time are dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def incremental(files: DataFrame, scan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Scans files as they arrive and appends what is found to a parquet folder; each batch goes to a folder of its own number, so that a batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        scan(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
