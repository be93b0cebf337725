"""Cutting lineage through the shared folder that the session names.

Executors can be lost at any time, so intermediate tables are written as Parquet below
``spark.checkpoint.dir`` (visible to every executor) and read back.  Only where the session leaves
that setting unset, as in tests, is a local folder used.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="spatialrank-"))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a scan of the written table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.scratch_path = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has made, after their last reader."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are no longer referred to, instead of at some later time.

    Spark deletes them in a thread of its own, which gets a moment.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.4)


@contextmanager
def prompt(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query as soon as it has ended: for tables that are written once each."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    while _MADE:
        spark, path = _MADE.pop()
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended first
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
