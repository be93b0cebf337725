"""Smoothing and interactions over the whole grid, against sums over all pairs of cells."""

import numpy as np
import pytest

import __spark_entry__
from spatialrank.plans.fixtures import GRID, Fixture

SF = "/root/testdata/sf0.001"


def layers(spark):
    found = np.zeros((8, GRID.yd, GRID.xd))
    for r in Fixture(spark, SF).occ.collect():
        found[r.feature, r.y, r.x] = r.value
    return found


def conn_at(layer, y, x):
    ys, xs = np.nonzero(layer)
    return (np.exp(-0.5 * np.hypot(np.subtract.outer(y, ys), np.subtract.outer(x, xs))) / (2 * np.pi * 0.25)) @ layer[ys, xs]


def found(spark, name):
    return {(r.y, r.x, r.feature): r.value for r in __spark_entry__.queries()[name](spark, SF).collect()}


def wanted(feature, y, x, v):
    return {(int(a), int(b), feature): c for a, b, c in zip(y, x, v / v.sum(), strict=True)}


def test_smoothing(spark):
    want = {}
    for feature, layer in enumerate(layers(spark)):
        y, x = np.nonzero(layer)
        want |= wanted(feature, y, x, conn_at(layer, y, x))
    assert found(spark, "distribution_smoothing") == pytest.approx(want, abs=2e-9)


@pytest.mark.parametrize("name, resource, consumer, gamma, sign", [("interaction_positive", 1, 2, 0.5, 1), ("interaction_negative", 3, 4, 0.8, -1)])
def test_interactions(spark, name, resource, consumer, gamma, sign):
    every = layers(spark)
    y, x = np.nonzero(every[resource])
    top = conn_at(every[consumer], *np.indices((GRID.yd, GRID.xd)).reshape(2, -1)).max()
    share = np.minimum(conn_at(every[consumer], y, x) / (gamma * top), 1)
    want = wanted(resource, y, x, every[resource][y, x] * (share if sign > 0 else 1 - share))
    assert found(spark, name) == pytest.approx(want, abs=2e-9)


def test_the_cut_kernel_has_no_sql_in_the_contract():
    assert not {"distribution_smoothing", "interaction_positive", "interaction_negative"} & set(__spark_entry__.oracle_sql())
