"""Progress of a scan, counted in the pass that does the work, and scans that can be called off between and inside passes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from brindle.operators import detect

COUNTERS = ("matched", "below_confidence", "low_priority")


def counters() -> list:
    """Aggregates over the rows of detect.scan: the counters of detect.scan_totals, the files with hits and the sites kept."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return [*sums, F.count(F.when(F.col("low_priority") > 0, 1)).alias("truncated"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("sites")), F.lit(0)).alias("sites")]


def observed_scan(files: DataFrame, profile: DataFrame | None = None) -> tuple[DataFrame, Observation]:
    """detect.scan, and an observation that has its counters once an action has written or read the rows: no job of its own."""
    observation = Observation(f"scan-{uuid.uuid4().hex}")
    return detect.scan(files, profile).observe(observation, *counters()), observation


class ScanProgress(StreamingQueryListener):
    """Listens to streams of scanned files (named rows of observe(name, *counters())) and hands each batch's counters, and their sums so far, to a callback."""

    def __init__(self, name: str, told: Callable[[int, dict[str, int], dict[str, int]], None]) -> None:
        self.name, self.told, self.total = name, told, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        batch = {k: int(v) for k, v in row.asDict().items()}
        self.total = {k: self.total.get(k, 0) + v for k, v in batch.items()}
        self.told(event.progress.batchId, batch, dict(self.total))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class Passes:
    """Named passes written one after the other, each in a folder of its own below a target, until one calls them off.

    cancel() may come from any thread: the pass at work is interrupted by its job tag, no further one begins, and what stands below the target
    are whole passes only: Spark's writers move a pass's files in place when all its tasks have ended, and a pass without their mark is removed.
    """

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target, self.tag = spark, target.rstrip("/"), f"passes-{uuid.uuid4().hex}"
        self._stop = threading.Event()
        self.done: list[str] = []

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def run(self, passes: dict[str, Callable[[], DataFrame]]) -> list[str]:
        """Runs the passes in order, and returns the names of those that are whole; a failure that is no cancellation is raised."""
        self.spark.sparkContext.addJobTag(self.tag)
        over = threading.Event()
        watch = threading.Thread(target=self._interrupting, args=(over,), daemon=True)
        watch.start()
        try:
            for name, made in passes.items():
                if self.cancelled:
                    break
                try:
                    made().write.mode("overwrite").parquet(f"{self.target}/pass={name}")
                except Exception:
                    self._removed(name)
                    if not self.cancelled:
                        raise
                    break
                self.done.append(name)
        finally:
            over.set()
            watch.join()
            self.spark.sparkContext.removeJobTag(self.tag)
        return self.done

    def _interrupting(self, over: threading.Event) -> None:
        """Until the run is over: what still begins after a cancellation, since its job was not there yet, is interrupted too."""
        while not over.wait(0.2):
            if self.cancelled:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _removed(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/pass={name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
