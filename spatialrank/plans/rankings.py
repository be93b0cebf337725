"""Greedy rankings of the whole landscape, one or ten units a round.

No SQL is given: recursion over every cell is too slow.  The same rankings of a corner of the landscape are in
``queries`` with recursive SQL; only tests run those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import greedy
from .fixtures import Fixture

#: The rankings of the corner; they aren't offered as queries.
WINDOWED = ("greedy_caz_window", "greedy_abf_window", "greedy_masked_window", "greedy_caz_blocks", "greedy_plu_window")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Fixture], DataFrame]):
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Fixture(spark, sf_dir))
    return function


@query
def greedy_caz_cells(f: Fixture) -> DataFrame:
    return greedy.rank_small(f.occ, f.features, "caz").select("y", "x", "round")


@query
def greedy_abf_cells(f: Fixture) -> DataFrame:
    return greedy.rank_small(f.occ, f.features, "abf").select("y", "x", "round")


@query
def greedy_masked_cells(f: Fixture) -> DataFrame:
    levels = f.occ.select("y", "x", F.floor((F.col("x") + F.col("y")) / 9.0).cast("int").alias("mask_level")).distinct()
    return greedy.rank_small(f.occ, f.features, "caz", 1, levels).select("y", "x", "round")


@query
def greedy_caz_tens(f: Fixture) -> DataFrame:
    return greedy.rank_small(f.occ, f.features, "caz", 10).select("y", "x", "round")


@query
def greedy_plu_units(f: Fixture) -> DataFrame:
    units = f.occ.groupBy(F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x"), "feature").agg(F.sum("value").alias("value"))
    return greedy.rank_small(units, f.features, "caz").select("y", "x", "round")
