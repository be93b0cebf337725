"""Connected patches of cells and networks of patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .focal import NEAR4, NEAR8, box, edge, shifted


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` and ``label``, the least id reachable; rounds of least neighbour and pointer jumping.

    The number of rounds grows with the logarithm of a component's width; each is checkpointed.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    if both.isEmpty():
        return nodes.select("id", F.col("id").alias("label"))
    labels = cut(nodes.select("id").withColumn("label", F.col("id")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        ahead = labels.select(F.col("id").alias("low"), F.col("label").alias("lowest"))
        after = cut(lower.join(ahead, "low").select("id", F.least("low", "lowest").alias("now"), "label"))
        labels = after.select("id", F.col("now").alias("label"))
        if not after.where("now <> label").limit(1).count():
            return labels


def _labelled(y: np.ndarray, x: np.ndarray, diagonal: bool) -> np.ndarray:
    """For cells sorted by y, x: the place of the first cell of each one's patch, by joining the runs of adjacent rows."""
    new = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
    first = np.flatnonzero(new)
    row, begin, end = y[first], x[first], x[np.append(first[1:], len(x)) - 1]
    root = list(range(len(first)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach, above = int(diagonal), 0
    for i in range(len(first)):
        while row[above] < row[i] - 1 or (row[above] == row[i] - 1 and end[above] + reach < begin[i]):
            above += 1
        k = above
        while row[k] == row[i] - 1 and begin[k] <= end[i] + reach:
            a, b = find(k), find(i)
            root[max(a, b)] = min(a, b)
            k += 1
    return first[np.array([find(i) for i in range(len(first))])][np.cumsum(new) - 1]


def patches(cells: DataFrame, xd: int, diagonal: bool = True, tile: int = 512) -> DataFrame:
    """y, x, label of each cell's patch; the label is the least y * xd + x in it.

    Cells are labelled within tiles, a task each; only what meets at the tiles' borders is joined over the cluster.
    """

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"])
        y, x = frame.y.to_numpy(), frame.x.to_numpy()
        first = _labelled(y, x, diagonal)
        return pd.DataFrame({"y": y, "x": x, "part": y[first].astype(np.int64) * xd + x[first]})

    side = lambda c: F.floor(F.col(c) / tile)
    tiled = cells.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct().groupBy(side("y").alias("ty"), side("x").alias("tx"))
    local = cut(tiled.applyInPandas(task, "y int, x int, part long"))
    ends = [F.pmod(c, F.lit(tile)).isin(0, tile - 1) for c in ("y", "x")]
    rim = local.where(ends[0] | ends[1])
    moved = shifted(rim.select("y", "x", F.col("part").alias("b")), NEAR8 if diagonal else NEAR4)
    edges = cut(rim.join(moved, ["y", "x"]).where("part <> b").select(F.col("part").alias("a"), "b").distinct())
    if edges.isEmpty():
        return local.withColumnRenamed("part", "label")
    joined = components(edges.select(F.col("a").alias("id")).distinct(), edges)
    return local.join(joined, local.part == joined.id, "left").select("y", "x", F.coalesce("label", "part").alias("label"))


def patch_stats(labels: DataFrame, rank: DataFrame) -> DataFrame:
    """Area, mean rank, centre and box of each patch."""
    joined = labels.join(rank.select("y", "x", "rank"), ["y", "x"])
    return joined.groupBy("label").agg(F.count("*").alias("area"), F.avg("rank").alias("mean_rank"), F.max("rank").alias("top_rank"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def patch_features(labels: DataFrame, occ: DataFrame) -> DataFrame:
    return labels.join(occ, ["y", "x"]).groupBy("label", "feature").agg(F.sum("value").alias("value"))


def component_stats(labels: DataFrame, occ: DataFrame) -> DataFrame:
    """Area, richness, boundary and the spread of each component."""
    cells = labels.join(occ.groupBy("y", "x").agg(F.sum("value").alias("richness")), ["y", "x"])
    near = shifted(labels.select("y", "x"), NEAR4).groupBy("y", "x").agg(F.count("*").alias("nb"))
    rows = cells.join(near, ["y", "x"], "left")
    return rows.groupBy("label").agg(F.count("*").alias("area"), F.sum("richness").alias("richness"), F.sum(4 - F.coalesce("nb", F.lit(0))).alias("boundary"), F.var_pop("x").alias("var_x"), F.var_pop("y").alias("var_y"))


def near_patches(labels: DataFrame, distance: int) -> DataFrame:
    """Pairs of patches a < b with cells at most ``distance`` apart; 0 gives none.

    Only cells beside a missing one can be a patch's nearest.  They meet on a tile: every cell goes to the tiles that its
    disc touches, the tile's side being the distance.
    """
    if distance <= 0:
        return labels.select(F.col("label").alias("a"), F.col("label").alias("b")).limit(0)
    tile = lambda c: F.floor(F.col(c) / distance).cast("int")
    tiled = labels.join(edge(labels), ["y", "x"], "left_semi").select("label", "y", "x", tile("y").alias("ty"), tile("x").alias("tx"))
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in box(1)))
    spread = tiled.withColumn("m", F.explode(moves)).select(F.col("label").alias("b"), F.col("y").alias("y2"), F.col("x").alias("x2"), (F.col("ty") + F.col("m.dy")).alias("ty"), (F.col("tx") + F.col("m.dx")).alias("tx"))
    far = (F.col("y") - F.col("y2")) ** 2 + (F.col("x") - F.col("x2")) ** 2
    return tiled.join(spread, ["ty", "tx"]).where((F.col("label") < F.col("b")) & (far <= distance * distance)).select(F.col("label").alias("a"), "b").distinct()


def levels(profiles: DataFrame, areas: DataFrame) -> DataFrame:
    """label, feature, level: densities against the mean density of all patches, cut at .01, .1, 1, 10, 100 times it."""
    cells = areas.agg(F.sum("area").alias("cells"))
    mean = profiles.groupBy("feature").agg(F.sum("value").alias("sum")).crossJoin(F.broadcast(cells)).select("feature", (F.col("sum") / F.col("cells")).alias("mean"))
    every = areas.select("label", "area").crossJoin(F.broadcast(mean)).join(profiles, ["label", "feature"], "left")
    d = F.coalesce("value", F.lit(0.0)) / F.col("area")
    m = F.col("mean")
    level = F.when(d < 0.01 * m, 0).when(d < 0.1 * m, 1).when(d < m, 2).when(d < 10 * m, 3).when(d < 100 * m, 4).otherwise(5)
    return every.select("label", "feature", level.cast("int").alias("level"))


def similarity(pairs: DataFrame, level: DataFrame) -> DataFrame:
    """The mean difference of levels of each pair."""
    x = level.select(F.col("label").alias("a"), "feature", F.col("level").alias("la"))
    y = level.select(F.col("label").alias("b"), "feature", F.col("level").alias("lb"))
    return pairs.join(x, "a").join(y, ["b", "feature"]).groupBy("a", "b").agg(F.avg(F.abs(F.col("la") - F.col("lb"))).alias("difference"))


def networks(stats: DataFrame, pairs: DataFrame, best_rank: float, most_difference: float) -> DataFrame:
    """label and network of the patches that a patch with a best cell reaches over near and similar patches."""
    nodes = stats.select(F.col("label").alias("id"))
    joined = components(nodes, pairs.where(F.col("difference") < most_difference)).join(stats.select(F.col("label").alias("id"), "top_rank"), "id")
    seeds = joined.where(F.col("top_rank") >= best_rank).select("label").distinct()
    return joined.join(seeds, "label", "left_semi").select(F.col("id").alias("label"), F.col("label").alias("network"))
