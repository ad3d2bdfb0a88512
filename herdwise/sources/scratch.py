"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which the shuffles of a statement are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Written(threading.local):
    """Folders that this thread wrote and has not deleted, oldest first."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a local master gets a new folder; a cluster gets an error, as its machines share no temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-herdwise-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.paths.append(path)
    return path


def _written(df: DataFrame, path: str, mode: str = "errorifexists", options: dict | None = None) -> None:
    """Write, and have Spark delete the shuffles of that write when it is done: else they stay until the driver happens to collect its garbage, and the disk holds all shuffles of a long job at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).options(**options or {}).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write once, read from then on: a restart point that outlives any executor, and that later jobs don't recompute. The shuffles of the write go with it. ``options`` are the writer's."""
    path = new_path(df.sparkSession, name)
    _written(df, path, options=options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, folder: str | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage of a long job: ``stored``, or, with a ``folder``, written there once under its name and only read by whoever runs the job again.

    The folder is the caller's to choose, one for each job and its input, and to delete.
    """
    if not folder:
        return stored(make(), name)
    path = f"{folder}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        _written(make(), path, "overwrite")
    return spark.read.parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_WRITTEN.paths)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders written after ``since`` but for the last ``keep`` of them: call it when what was made from them is written."""
    written = _WRITTEN.paths
    for path in written[since : len(written) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    written[since : len(written) - keep] = []
