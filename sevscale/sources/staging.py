"""Tables staged in the folder the cluster shares.

A staged table cuts lineage and pins values that later steps read more than once.  It is
written through the normal parquet committer, so losing an executor loses nothing.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Whether Spark removes the shuffle files of a write when it ends, else whenever the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writes: dict[SparkSession, tuple[int, str | None]] = {}


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the write inside; the session's own setting is back after the last of overlapping writes."""
    with _lock:
        n, before = _writes.get(spark) or (0, spark.conf.get(CLEANUP, None))
        _writes[spark] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writes.pop(spark)
            if n > 1:
                _writes[spark] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def staging_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sevscale-"))
    return context.getCheckpointDir()


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write the frame once and hand back a reader of what was written."""
    return stage_at(df, staged_path(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """Stage at a given path, in place of what an earlier round left there."""
    with _cleaned(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
