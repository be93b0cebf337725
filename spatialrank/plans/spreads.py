"""Smoothing and interactions with the exponential kernel over the whole grid.

No SQL is given: a join of every cell with every occurrence is too slow.  The queries of the same names in ``queries``
cut the kernel to seven by seven cells as their SQL does; only tests run those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import focal
from .fixtures import GRID, Fixture
from .queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPONENTIAL = focal.whole_grid(GRID.yd, GRID.xd, lambda d: np.exp(-0.5 * d) / (2 * np.pi * 0.25))


def query(function: Callable[[Fixture], DataFrame]):
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Fixture(spark, sf_dir))
    return function


@query
def distribution_smoothing(f: Fixture) -> DataFrame:
    return rounded(focal.smoothed(f.occ, EXPONENTIAL), 9)


@query
def interaction_positive(f: Fixture) -> DataFrame:
    return rounded(focal.attracted(f.occ, 1, 2, EXPONENTIAL, 0.5), 9)


@query
def interaction_negative(f: Fixture) -> DataFrame:
    return rounded(focal.avoided(f.occ, 3, 4, EXPONENTIAL, 0.8), 9)
