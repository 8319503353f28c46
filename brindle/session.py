"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to Python at once, where a session has its default: rows are whole texts, and a batch stands in the memory of both sides.
ARROW_ROWS, _ARROW_DEFAULT = 1000, "10000"
_ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a file where the number of rows is known.
ROWS_A_FILE = 250_000
#: Paths of the tables that cut has written, by application.
_written: dict[str, list[str]] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brindle")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, as in tests, one is made and set; a cluster has to name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands ARROW_ROWS rows to Python at once, unless it was told another number than Spark's own."""
    if spark.conf.get(_ARROW_KEY) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, str(ARROW_ROWS))


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends in files that no lost executor takes away.

    rows: what df has at most, where that is known: a small table is then written in few files, ROWS_A_FILE rows each, however many tasks made it."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    written(spark, path)
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // ROWS_A_FILE))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def written(spark: SparkSession, path: str) -> str:
    """Notes a folder below the shared one, so that clear and scratch delete it as they do what cut has written; gives the path back."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes what cut has written for a session: call it when no frame made from it is read any more."""
    _deleted(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, the function given cuts a frame that is to stay; all else that is written meanwhile is deleted at the end."""
    app = spark.sparkContext.applicationId
    before, stay = len(_written.get(app, [])), []

    def kept(df: DataFrame) -> DataFrame:
        out = cut(df, "kept")
        stay.append(_written[app][-1])
        return out

    yield kept
    new = _written.get(app, [])[before:]
    _written[app] = _written.get(app, [])[:before] + stay
    _deleted(spark, [p for p in new if p not in stay])
