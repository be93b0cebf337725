"""Cutting lineage, numbering and running sums without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the cluster names; a local one of its own only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spatialrank-"))
    return df.checkpoint()


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names; below a local one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spatialrank-"))
    return f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[Column], name: str = "step") -> DataFrame:
    """``df`` with its row number from 1 in a total order: range partitions are sorted, counted and shifted.

    Only a count for each partition is gathered in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = local.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__part", before.alias("__before"))
    joined = local.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def running_sum(df: DataFrame, key: list[str], order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """The sum of ``value`` up to and with each row, by ``key`` in the order of the whole number ``order``.

    Windows span blocks of the order; the sums of the blocks before are added, so that one key's rows
    needn't fit one task.
    """
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    totals = rows.groupBy(*key, "__block").agg(F.sum(value).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    within = F.sum(value).over(Window.partitionBy(*key, "__block").orderBy(order))
    joined = rows.withColumn("__within", within).join(totals.select(*key, "__block", before.alias("__before")), [*key, "__block"])
    return joined.withColumn(name, F.col("__before") + F.col("__within")).drop("__block", "__within", "__before")
