"""Benefit and kernel functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def root4(x: Column) -> Column:
    """x to the power 1/4 by square roots, equal in every engine."""
    return F.sqrt(F.sqrt(x))


def power(x: Column, p: Column) -> Column:
    """x**p; the common exponents by square roots."""
    return F.when(p == 1.0, x).when(p == 0.5, F.sqrt(x)).when(p == 0.25, root4(x)).otherwise(F.pow(x, p))


def rr4(r: Column, w1: Column, t: Column, w2: Column, e1: Column, e2: Column) -> Column:
    """The generalised benefit: one power below the target, another above."""
    below = w1 * power(r / t, e1)
    above = w1 + w2 * power((r - t) / (1 - t), e2)
    return F.when((r <= t) | (t >= 1), below).otherwise(above)


def extinction(r: Column, z: float = 0.25) -> Column:
    kept = F.greatest(r, F.lit(0.0))
    return 1 - (root4(kept) if z == 0.25 else F.pow(kept, F.lit(z)))


def loss(value: Column, profile: list[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup of ``value`` in (x, y) points; outside it is the end's."""
    points = sorted(profile)
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(value <= x1, F.lit(y0) + (value - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(value <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


#: name -> (distance, parameter) -> weight
KERNELS: dict[str, Callable[[Column, float], Column]] = {
    "exponential": lambda d, a: F.exp(-a * d) / F.lit(2 * 3.141592653589793 * a * a),
    "gaussian": lambda d, a: F.exp(-(d * d) / (2 * a * a)),
    "threshold": lambda d, a: F.when(d < a, 1.0).otherwise(0.0),
    "triangular": lambda d, a: F.greatest(1 - d / a, F.lit(0.0)),
}


def tabulated(points: list[tuple[float, float]]) -> Callable[[Column, float], Column]:
    """A kernel from a table of (distance, weight), linear between, never below 0."""
    if any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("distances must increase")
    return lambda d, a: F.greatest(loss(d, points), F.lit(0.0))
