"""Neighbourhood operators, as joins on shifted cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.benefit import KERNELS
from .transforms import normalise

NEAR4 = ((-1, 0), (1, 0), (0, -1), (0, 1))
NEAR8 = NEAR4 + ((-1, -1), (-1, 1), (1, -1), (1, 1))


def box(radius: int) -> tuple[tuple[int, int], ...]:
    return tuple((dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))


def shifted(rows: DataFrame, offsets) -> DataFrame:
    """A copy of every row for each offset, at the cell it is a neighbour of; an offset has dy, dx and what goes with it."""
    moves = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dy", "dx", "k"), strict=False))) for o in offsets))
    moved = rows.withColumn("__m", F.explode(moves))
    return moved.withColumn("y", F.col("y") - F.col("__m.dy")).withColumn("x", F.col("x") - F.col("__m.dx"))


def counted(cells: DataFrame, offsets, name: str = "nb") -> DataFrame:
    """How many cells of ``cells`` lie at the offsets from each of them; 0 where none does."""
    near = shifted(cells.select("y", "x"), offsets).groupBy("y", "x").agg(F.count("*").alias(name))
    return cells.select("y", "x").join(near, ["y", "x"], "left").select("y", "x", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def corners(cells: DataFrame) -> DataFrame:
    return counted(cells, NEAR8[4:], "corners")


def boundary_length(cells: DataFrame) -> DataFrame:
    """The sides of cells that face none."""
    return counted(cells, NEAR4).agg(F.sum(4 - F.col("nb")).alias("boundary"), F.count("*").alias("n"))


def edge(cells: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """The cells next to a missing one and, given mask levels, next to a cell of another level."""
    marked = counted(cells, NEAR8).where("nb < 8").select("y", "x")
    if levels is not None:
        moved = shifted(levels.select("y", "x", F.col("mask_level").alias("other")), NEAR8)
        borders = levels.join(moved, ["y", "x"]).where("mask_level <> other").select("y", "x")
        marked = marked.union(borders).distinct()
    return marked


def border(cells: DataFrame) -> DataFrame:
    """The missing cells that touch a cell with data."""
    return shifted(cells.select("y", "x"), NEAR8).select("y", "x").distinct().join(cells, ["y", "x"], "left_anti")


def clearance(cells: DataFrame) -> DataFrame:
    """How much room is around each cell: in four directions (rows, columns, both diagonals) the steps that can be made to
    both sides at once, the cell itself being the first; the whole part of the root of the sum of their squares."""
    lines = {"e": F.col("y"), "n": F.col("x"), "d": F.col("y") - F.col("x"), "u": F.col("y") + F.col("x")}
    out = cells.select("y", "x")
    for name, line in lines.items():
        along = F.col("y") if name == "n" else F.col("x")
        runs = Window.partitionBy("__line", "__run")
        out = out.withColumn("__line", line).withColumn("__at", along).withColumn("__run", F.col("__at") - F.row_number().over(Window.partitionBy("__line").orderBy("__at")))
        both = F.least(F.col("__at") - F.min("__at").over(runs), F.max("__at").over(runs) - F.col("__at")) + 1
        out = out.withColumn(name, both).drop("__line", "__at", "__run")
    return out.select("y", "x", F.floor(F.sqrt(sum((F.col(n) * F.col(n) for n in lines), F.lit(0)))).cast("int").alias("room"))


def eroded(cells: DataFrame, rounds: int) -> DataFrame:
    """What is left after ``rounds`` of taking away the cells without all eight neighbours."""
    for _ in range(rounds):
        cells = counted(cells, NEAR8).where("nb = 8").select("y", "x")
    return cells


def kernel(name: str | Callable[[Column, float], Column], alpha: float, radius: int, size: float = 1.0) -> list[tuple[int, int, Column]]:
    weigh = KERNELS[name] if isinstance(name, str) else name
    return [(dy, dx, weigh(F.lit(float(np.hypot(dy, dx)) * size), alpha)) for dy, dx in box(radius)]


def convolve(occ: DataFrame, weights: list[tuple[int, int, Column]]) -> DataFrame:
    """conn at each cell that any kernel reaches: the sum of value times weight over the neighbourhood, by feature.

    Every occurrence goes to the cells it adds to, so the shuffle is by cell and feature, and sums are taken
    before it.
    """
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), k.cast("double").alias("k")) for dy, dx, k in weights))
    moved = occ.withColumn("__m", F.explode(moves)).where("__m.k <> 0")
    return moved.groupBy((F.col("y") - F.col("__m.dy")).alias("y"), (F.col("x") - F.col("__m.dx")).alias("x"), "feature").agg(F.sum(F.col("value") * F.col("__m.k")).alias("conn"))


def convolve_fft(occ: DataFrame, yd: int, xd: int, function: Callable[[np.ndarray], np.ndarray], everywhere: bool = False) -> DataFrame:
    """As ``convolve`` with a kernel over the whole grid, by FFT, one feature at a time; ``function`` gives weights of
    distances.  At the feature's own cells, or ``everywhere`` on the grid.  A feature's layer must fit a task."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        layer = np.zeros((2 * yd, 2 * xd))
        layer[frame.y, frame.x] = frame.value
        dy, dx = np.minimum(np.arange(2 * yd), 2 * yd - np.arange(2 * yd)), np.minimum(np.arange(2 * xd), 2 * xd - np.arange(2 * xd))
        weights = np.where((dy[:, None] < yd) & (dx < xd), function(np.hypot(dy[:, None], dx)), 0.0)
        out = np.fft.irfft2(np.fft.rfft2(layer) * np.fft.rfft2(weights), layer.shape)
        y, x = np.indices((yd, xd)).reshape(2, -1) if everywhere else (frame.y.to_numpy(), frame.x.to_numpy())
        return pd.DataFrame({"y": y, "x": x, "feature": frame.feature.iloc[0], "conn": out[y, x]})

    return occ.groupBy("feature").applyInPandas(task, "y int, x int, feature int, conn double")


#: What spreads occurrences: offsets with weights, or a function from occurrences to conn at every cell.
Spread = list[tuple[int, int, Column]] | Callable[[DataFrame], DataFrame]


def whole_grid(yd: int, xd: int, function: Callable[[np.ndarray], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """The spread by a kernel over the whole grid."""
    return lambda occ: convolve_fft(occ, yd, xd, function, everywhere=True)


def spread(occ: DataFrame, weights: Spread) -> DataFrame:
    return weights(occ) if callable(weights) else convolve(occ, weights)


def at_present(conn: DataFrame, occ: DataFrame) -> DataFrame:
    return occ.select("y", "x", "feature").join(conn, ["y", "x", "feature"]).select("y", "x", "feature", F.col("conn").alias("value"))


def smoothed(occ: DataFrame, weights: Spread) -> DataFrame:
    """Every feature spread by its kernel, on the cells where it is present, normalised."""
    return normalise(at_present(spread(occ, weights), occ))


def _limit(conn: DataFrame, gamma: float) -> DataFrame:
    return conn.agg((F.max("conn") * gamma).alias("limit"))


def _interacted(occ: DataFrame, resource: int, consumer: int, weights, gamma: float, factor: Callable[[Column], Column]) -> DataFrame:
    conn = spread(occ.where(F.col("feature") == consumer), weights).select("y", "x", "conn")
    near = conn.crossJoin(F.broadcast(_limit(conn, gamma))).select("y", "x", (F.col("conn") / F.col("limit")).alias("share"))
    own = occ.where(F.col("feature") == resource).join(near, ["y", "x"], "left")
    changed = own.select("y", "x", "feature", (F.col("value") * factor(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0)))).alias("value"))
    return normalise(changed)


def attracted(occ: DataFrame, resource: int, consumer: int, weights, gamma: float = 1.0) -> DataFrame:
    """The resource where the consumer is near: times conn / limit up to the limit, gamma of the largest conn."""
    return _interacted(occ, resource, consumer, weights, gamma, lambda s: s)


def avoided(occ: DataFrame, resource: int, consumer: int, weights, gamma: float = 1.0) -> DataFrame:
    """The resource where the other is far: times 1 - conn / limit."""
    return _interacted(occ, resource, consumer, weights, gamma, lambda s: 1 - s)


def connected(occ: DataFrame, matrix: DataFrame, weights: Spread, gamma: float = 1.0, edge: DataFrame | None = None) -> DataFrame:
    """Matrix connectivity: every feature times min(1, conn / (gamma max conn)), conn being the spread of all
    features weighted by their similarity; normalised.

    ``edge`` (y, x, value) is what lies outside the data, as water: conn is divided by 1 - its own spread over the spread of
    everything, so that cells beside it don't count as isolated.
    """
    mixed = occ.join(F.broadcast(matrix), occ.feature == matrix.j).groupBy("y", "x", F.col("i").alias("feature")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    conn = spread(mixed, weights)
    if edge is not None:
        outside = spread(edge.select("y", "x", F.lit(0).alias("feature"), "value"), weights).select("y", "x", F.col("conn").alias("outside"))
        whole = occ.select("y", "x").distinct().withColumn("value", F.lit(1.0)).unionByName(edge.select("y", "x", "value"))
        around = spread(whole.select("y", "x", F.lit(0).alias("feature"), "value"), weights).select("y", "x", F.col("conn").alias("around"))
        share = F.coalesce(F.col("outside") / F.col("around"), F.lit(0.0))
        conn = conn.join(outside, ["y", "x"], "left").join(around, ["y", "x"], "left").select("y", "x", "feature", F.when(share < 1, F.col("conn") / (1 - share)).otherwise(F.col("conn")).alias("conn"))
    tops = conn.groupBy("feature").agg((F.max("conn") * gamma).alias("top"))
    joined = occ.join(conn, ["y", "x", "feature"]).join(F.broadcast(tops), "feature")
    return normalise(joined.select("y", "x", "feature", (F.col("value") * F.least(F.col("conn") / F.col("top"), F.lit(1.0))).alias("value")))


def occupancy(rank: DataFrame, level: float, radius: int) -> DataFrame:
    """The share of each cell's neighbourhood that has at least the rank ``level``."""
    high = shifted(rank.where(F.col("rank") >= level).select("y", "x"), [o for o in box(radius) if o != (0, 0)])
    near = high.groupBy("y", "x").agg(F.count("*").alias("n"))
    size = (2 * radius + 1) ** 2 - 1
    return rank.select("y", "x").join(near, ["y", "x"], "left").select("y", "x", (F.coalesce("n", F.lit(0)) / size).alias("occupancy"))


def fragmentation(occ: DataFrame, shares: DataFrame, betas: list[float]) -> DataFrame:
    """For each beta the least over features of the sum of value * exp(-beta (1 - share of neighbours))."""
    scan = occ.join(shares, ["y", "x"]).withColumn("beta", F.explode(F.array(*(F.lit(float(b)) for b in betas))))
    sums = scan.groupBy("beta", "feature").agg(F.sum(F.col("value") * F.exp(-F.col("beta") * (1 - F.col("share")))).alias("kept"))
    return sums.groupBy("beta").agg(F.min("kept").alias("least"))
