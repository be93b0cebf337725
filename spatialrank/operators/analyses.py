"""Analyses of a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .focal import boundary_length
from .graph import levels, near_patches, networks, patch_features, patch_stats, patches, similarity


def top(rank: DataFrame, fraction: float) -> DataFrame:
    """The best fraction of the ranking; a negative one is the worst."""
    return rank.where(F.col("rank") >= 1 - fraction) if fraction > 0 else rank.where(F.col("rank") <= -fraction)


def landscape_networks(rank: DataFrame, occ: DataFrame, xd: int, fraction: float, best: float, distance: int, difference: float, mask: DataFrame | None = None) -> DataFrame:
    """y, x, label, network: patches of the best fraction (in a mask), joined by distance and similarity."""
    cells = top(rank, fraction)
    if mask is not None:
        cells = cells.join(mask, ["y", "x"], "left_semi")
    labels = patches(cells, xd)
    stats = patch_stats(labels, rank)
    level = levels(patch_features(labels, occ), stats)
    pairs = similarity(near_patches(labels, distance), level)
    return labels.join(networks(stats, pairs, 1 - best, difference), "label", "left").select("y", "x", "label", "network")


def unit_report(groups: DataFrame, rank: DataFrame, occ: DataFrame, key: str) -> DataFrame:
    """For each group of cells: area, mean rank, centre, and how many features it holds over some shares of."""
    sums = occ.groupBy("feature").agg(F.sum("value").alias("total"))
    areas = groups.join(rank.select("y", "x", "rank"), ["y", "x"]).groupBy(key).agg(F.count("*").alias("area"), F.avg("rank").alias("mean_rank"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    held = groups.join(occ, ["y", "x"]).groupBy(key, "feature").agg(F.sum("value").alias("value")).join(F.broadcast(sums), "feature")
    share = F.col("value") / F.col("total")
    over = [F.count_if(share > s).alias(n) for n, s in (("over_10", 0.1), ("over_1", 0.01), ("over_01", 0.001), ("over_001", 0.0001))]
    return areas.join(held.groupBy(key).agg(F.sum(share).alias("shares"), *over), key, "left")


def comparison(first: DataFrame, second: DataFrame, f1: float, f2: float) -> DataFrame:
    """Each cell's class: 1 in both fractions, 2 first only, 3 second only, 0 in neither."""
    x, y = first.select("y", "x", F.col("rank").alias("r1")), second.select("y", "x", F.col("rank").alias("r2"))
    both = x.join(y, ["y", "x"], "full_outer")
    inside = lambda c, f: F.coalesce(F.col(c) >= 1 - f if f > 0 else F.col(c) <= -f, F.lit(False))
    kind = F.when(inside("r1", f1) & inside("r2", f2), 1).when(inside("r1", f1), 2).when(inside("r2", f2), 3).otherwise(0)
    return both.select("y", "x", kind.cast("int").alias("class"), "r1", "r2")


def comparison_summary(first: DataFrame, second: DataFrame, f1: float, f2: float) -> DataFrame:
    rows = comparison(first, second, f1, f2)
    n = lambda *kinds: F.count_if(F.col("class").isin(*kinds))
    return rows.agg(n(1, 2).alias("n_first"), n(1, 3).alias("n_second"), n(1).alias("n_both"), (n(1) / n(1, 2)).alias("overlap_first"), (n(1) / n(1, 3)).alias("overlap_second"), F.avg(F.abs(F.col("r1") - F.col("r2"))).alias("mean_difference"))


def fraction_report(rank: DataFrame, occ: DataFrame, cost: DataFrame, features: DataFrame, fraction: float) -> DataFrame:
    """Boundary, area, cost and what the best fraction keeps of the features."""
    cells = top(rank, fraction).select("y", "x")
    sums = occ.groupBy("feature").agg(F.sum("value").alias("total"))
    kept = occ.join(cells, ["y", "x"], "left_semi").groupBy("feature").agg(F.sum("value").alias("kept"))
    shares = sums.join(kept, "feature", "left").join(features.select("feature", "weight"), "feature").withColumn("share", F.coalesce("kept", F.lit(0.0)) / F.col("total"))
    means = shares.agg(F.min("share").alias("min_rem"), F.avg("share").alias("mean_rem"), (F.sum(F.col("share") * F.col("weight")) / F.sum("weight")).alias("wmean_rem"))
    money = cells.join(cost, ["y", "x"]).agg(F.sum("cost").alias("cost"))
    return boundary_length(cells).crossJoin(money).crossJoin(means)


def histogram(occ: DataFrame, bins: int = 20) -> DataFrame:
    """How many occurrences of each feature fall in each bin of value over its largest."""
    tops = occ.groupBy("feature").agg(F.max("value").alias("top"))
    joined = occ.join(F.broadcast(tops), "feature")
    return joined.groupBy("feature", F.floor(F.col("value") * bins / F.col("top")).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cells_for(occ: DataFrame, share: float) -> DataFrame:
    """The fewest cells that hold ``share`` of each feature, the richest first.

    Cells of equal value are counted together, so that windows run over different values and not over cells.
    """
    by = occ.groupBy("feature", "value").agg(F.count("*").alias("n"))
    down = Window.partitionBy("feature").orderBy(F.desc("value"))
    rows = by.withColumn("sum", F.sum(F.col("value") * F.col("n")).over(down)).withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum(F.col("value") * F.col("n")).over(Window.partitionBy("feature")))
    before = F.col("sum") - F.col("value") * F.col("n")
    need = F.col("all") * share
    here = rows.where((before < need) & (F.col("sum") >= need))
    return here.select("feature", (F.col("upto") - F.col("n") + F.ceil((need - before) / F.col("value"))).cast("long").alias("n_cells"))


def points_to_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Point observations on present cells, each feature summing to 1."""
    kept = points.join(cells.select("y", "x"), ["y", "x"], "left_semi")
    sums = kept.groupBy("feature").agg(F.sum("value").alias("total"))
    return kept.join(F.broadcast(sums), "feature").select("y", "x", "feature", (F.col("value") / F.col("total")).alias("value"))
