"""Curves and reports over a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.benefit import extinction


def snapshots(n: int, most: int = 1000) -> int:
    """The distance of snapshots."""
    return max(1, n // most)


def at_steps(steps: DataFrame, occ: DataFrame, order: DataFrame) -> DataFrame:
    """step, feature, repr at each of ``steps``: what the removals up to the step have left.

    Removed values are summed by the snapshot they fall before, so only features times snapshots are windowed.
    """
    marks = [r.step for r in steps.orderBy("step").collect()]
    sums = occ.groupBy("feature").agg(F.sum("value").alias("total"))
    cuts = F.array(*(F.lit(m) for m in marks))
    number = F.size(F.filter(cuts, lambda m: m < F.col("step")))
    lost = occ.join(order.select("y", "x", "step"), ["y", "x"]).groupBy("feature", number.alias("part")).agg(F.sum("value").alias("value"))
    every = sums.crossJoin(steps.sparkSession.createDataFrame(list(enumerate(marks)), "part int, step long"))
    joined = every.join(lost, ["feature", "part"], "left")
    running = F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy("feature").orderBy("part"))
    return joined.select("step", "feature", (1 - running / F.col("total")).alias("repr"))


def summary(curves: DataFrame, features: DataFrame, z: float = 0.25) -> DataFrame:
    """By step over features of weight 0 or more: min, mean, weighted mean, and extinction risks."""
    rows = curves.join(F.broadcast(features.select("feature", "weight")), "feature").where("weight >= 0")
    risk, w = extinction(F.col("repr"), z), F.col("weight")
    return rows.groupBy("step").agg(F.min("repr").alias("min_rem"), F.avg("repr").alias("mean_rem"), (F.sum(F.col("repr") * w) / F.sum(w)).alias("wmean_rem"), F.avg(risk).alias("ext1"), (F.sum(risk * w) / F.sum(w)).alias("ext2"))


def by_group(curves: DataFrame, features: DataFrame, z: float = 0.25) -> DataFrame:
    rows = curves.join(F.broadcast(features.select("feature", "weight", "grp")), "feature").where("weight >= 0")
    w = F.col("weight")
    return rows.groupBy("step", "grp").agg(F.min("repr").alias("min_rem"), F.avg("repr").alias("mean_rem"), F.max("repr").alias("max_rem"), (F.sum(F.col("repr") * w) / F.sum(w)).alias("wmean_rem"), F.avg(extinction(F.col("repr"), z)).alias("ext_risk"))


def wide(curves: DataFrame, names: list[int]) -> DataFrame:
    """One column for each feature."""
    return curves.groupBy("step").pivot("feature", names).agg(F.first("repr"))


def violations(curves: DataFrame, features: DataFrame) -> DataFrame:
    """The first step at which each feature is below its target, and at which nothing is left."""
    rows = curves.join(F.broadcast(features.select("feature", "tj")), "feature")
    return rows.groupBy("feature").agg(F.min(F.when(F.col("repr") < F.col("tj"), F.col("step"))).alias("violated_at"), F.min(F.when(F.col("repr") <= 1e-12, F.col("step"))).alias("lost_at"))


def feature_report(occ: DataFrame, features: DataFrame, curves: DataFrame) -> DataFrame:
    """Weight, distribution sum, centre and violation of each feature."""
    mean = lambda c: F.sum(F.col("value") * F.col(c)) / F.sum("value")
    sums = occ.groupBy("feature").agg(F.sum("value").alias("total"), mean("x").alias("cx"), mean("y").alias("cy"))
    return features.select("feature", "name", "weight").join(sums, "feature").join(violations(curves, features), "feature", "left")


def removal_rows(order: DataFrame, cost: DataFrame) -> DataFrame:
    """For each removal: rank i/n, proportion lost (i + 1)/(n + 1), and cells left n - i."""
    n = order.agg(F.count("*").alias("n"))
    joined = order.join(cost, ["y", "x"]).crossJoin(F.broadcast(n))
    return joined.select("y", "x", "step", (F.col("step") / F.col("n")).alias("rank"), ((F.col("step") + 1) / (F.col("n") + 1)).alias("prop_lost"), (F.col("n") - F.col("step")).alias("cells_left"), "cost")


def loss_map(occ: DataFrame, order: DataFrame, features: DataFrame, blocks: int = 100) -> DataFrame:
    """y, x, prop_loss: 1 - the least representation, over features of weight 0 or more, at the start of the block of the
    ranking in which a cell goes.  Removed values are summed by block, so windows span features times blocks."""
    n = order.agg(F.count("*").alias("n"))
    placed = order.crossJoin(F.broadcast(n)).select("y", "x", F.ceil(F.col("step") * blocks / F.col("n")).cast("int").alias("block"))
    kept = features.where("weight >= 0").select("feature")
    sums = occ.join(F.broadcast(kept), "feature", "left_semi").groupBy("feature").agg(F.sum("value").alias("total")).where("total > 0")
    lost = occ.join(placed, ["y", "x"]).groupBy("feature", "block").agg(F.sum("value").alias("value"))
    every = sums.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks)))).join(lost, ["feature", "block"], "left")
    before = F.coalesce(F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    least = every.select("block", (before / F.col("total")).alias("lost")).groupBy("block").agg(F.max("lost").alias("prop_loss"))
    return placed.join(F.broadcast(least), "block", "left").select("y", "x", F.coalesce("prop_loss", F.lit(0.0)).alias("prop_loss"))


def bands(rank: DataFrame) -> DataFrame:
    """Seven bands of rank, by the usual breaks."""
    r = F.col("rank")
    band = F.when(r < 0.2, 1).when(r < 0.5, 2).when(r < 0.75, 3).when(r < 0.9, 4).when(r < 0.95, 5).when(r < 0.98, 6).otherwise(7)
    return rank.select("y", "x", band.cast("int").alias("band"))


def fraction_for_cost(curve: DataFrame, cost: float) -> DataFrame:
    """The proportion left whose remaining cost is ``cost``, by linear interpolation on (prop_left, cost_left)."""
    w = Window.orderBy("cost_left", "prop_left")
    pairs = curve.withColumn("next_cost", F.lead("cost_left").over(w)).withColumn("next_prop", F.lead("prop_left").over(w))
    hit = pairs.where((F.col("cost_left") <= cost) & (F.col("next_cost") > cost))
    part = (F.lit(cost) - F.col("cost_left")) / (F.col("next_cost") - F.col("cost_left"))
    return hit.select((F.col("prop_left") + part * (F.col("next_prop") - F.col("prop_left"))).alias("fraction"))


def moving_average(rounds: DataFrame, value: str, keep: float = 0.95) -> DataFrame:
    """round and the moving average of ``value``: keep times the last average and 1 - keep times the new value.

    A ranking has some hundred rounds, so they are one array."""
    rows = rounds.agg(F.array_sort(F.collect_list(F.struct("round", F.col(value).alias("value")))).alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<round:bigint,average:double>>").alias("out"))

    def step(held, row):
        now = F.coalesce(held["last"] * keep + row["value"] * (1 - keep), row["value"])
        return F.struct(now.alias("last"), F.concat(held["out"], F.array(F.struct(row["round"].cast("bigint").alias("round"), now.alias("average")))).alias("out"))

    return rows.select(F.inline(F.aggregate("rows", start, step, lambda held: held["out"])))


def point_report(points: DataFrame, order: DataFrame) -> DataFrame:
    """For each point feature: its points' cells, their sum, and the rank at which the last of them goes."""
    joined = points.join(order.select("y", "x", "rank"), ["y", "x"])
    return joined.groupBy("feature").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"), F.max("rank").alias("lost_at"))
