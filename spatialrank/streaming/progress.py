"""The progress feed: rounds of removals are appended to a folder that a stream tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "y int, x int, round int, place int"


def publish(removals: DataFrame, path: str) -> None:
    """Append a round's removals; a reader sees whole files only."""
    removals.select("y", "x", "round", "place").write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of removals."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def rounds(removals: DataFrame) -> DataFrame:
    """How many cells each round removed; of a stream or a table."""
    return removals.groupBy("round").agg(F.count("*").alias("n_removed"))
