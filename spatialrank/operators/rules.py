"""What a unit's removal costs: the removal rules and the penalties added to them.

``units`` are rows (unit columns..., feature, value); ``state`` has feature, weight, the rule's parameters and the
current representation ``r``.  A rule gives ``delta`` for each unit, before any division by cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.benefit import loss, power, root4, rr4
from .focal import NEAR4, NEAR8, box, counted, shifted


def _core_area(n: int) -> tuple[Column, ...]:
    share = F.col("weight") * F.col("value") / F.col("r")
    worst = F.max(F.when(F.col("weight") >= 0, share))
    relief = F.min(F.when(F.col("weight") < 0, share))
    return (F.coalesce(worst, F.lit(0.0)) + F.coalesce(F.least(relief, F.lit(0.0)), F.lit(0.0)),)


def _additive(n: int) -> tuple[Column, ...]:
    slope = F.when(F.col("sr_par") == 0.25, 1 / (F.sqrt("r") * root4(F.col("r")))).otherwise(power(F.col("r"), F.col("sr_par") - 1))
    return (F.sum(F.when(F.col("r") > 0, F.col("value") * F.col("weight") * F.col("sr_par") * slope)),)


def _target(n: int) -> tuple[Column, ...]:
    r, v, t = F.col("r"), F.col("value"), F.col("tj")
    over = (r - t) / (1 - t)
    rising = F.when(F.col("weight") < 0, v * -4 * over * over * over).otherwise(v * 0.25 / (F.sqrt(over) * root4(over)))
    return (F.sum(F.when(r - v > t, rising).when(r < t, 0.0).otherwise(F.lit(float(n)))),)


def _generalised(n: int) -> tuple[Column, ...]:
    p = [F.col(c) for c in ("weight", "tj", "w2", "exp1", "exp2")]
    return (F.sum(rr4(F.col("r"), *p) - rr4(F.greatest(F.col("r") - F.col("value"), F.lit(0.0)), *p)),)


#: name -> (number of features) -> aggregates whose sum is the delta
RULES: dict[str, Callable[[int], tuple[Column, ...]]] = {"caz": _core_area, "abf": _additive, "tbf": _target, "gbf": _generalised}


def state(occ: DataFrame, features: DataFrame) -> DataFrame:
    """Features with their present representation; a few columns for each feature."""
    return features.join(occ.groupBy("feature").agg(F.sum("value").alias("r")), "feature")


def deltas(units: DataFrame, now: DataFrame, rule: str, n_features: int, by: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The rule's delta of each unit."""
    joined = units.join(F.broadcast(now), "feature")
    (delta,) = RULES[rule](n_features)
    return joined.groupBy(*by).agg(F.coalesce(delta, F.lit(0.0)).alias("delta"))


def random_deltas(units: DataFrame, seed: int, by: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """A uniform number for each unit, the same for the same seed."""
    h = F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 52))
    return units.select(*by).distinct().withColumn("delta", h / float(1 << 52))


def over_cost(found: DataFrame, cost: DataFrame, by: tuple[str, ...] = ("y", "x")) -> DataFrame:
    return found.join(cost.select(*by, "cost"), list(by)).withColumn("delta", F.col("delta") / F.col("cost")).drop("cost")


def boundary_term(cells: DataFrame, blp: float) -> DataFrame:
    """What is subtracted from a cell's delta for the boundary: BLP (BL/n - (BL + change)/(n - 1)).

    The change is that of the boundary's length by the number of present 4-neighbours; two neighbours give 0.
    """
    near = counted(cells, NEAR4).withColumnRenamed("nb", "nb4")
    whole = near.agg(F.sum(4 - F.col("nb4")).alias("bl"), F.count("*").alias("n"))
    change = F.col("nb4") * 2 - 4
    term = F.lit(blp) * (F.col("bl") / F.col("n") - (F.col("bl") + change) / (F.col("n") - 1))
    return near.crossJoin(F.broadcast(whole)).select("y", "x", "nb4", F.when((F.col("nb4") == 2) | (F.col("n") <= 1), 0.0).otherwise(term).alias("term"))


def local_quality_loss(occ: DataFrame, now: DataFrame, before: DataFrame, radius: int, profile: list[tuple[float, float]]) -> DataFrame:
    """value times the response to the share of the neighbours ``before`` that are there ``now``."""
    ring = [o for o in box(radius) if o != (0, 0)]
    joined = counted(now, ring, "left").join(counted(before, ring, "orig"), ["y", "x"])
    share = F.when(F.col("orig") > 0, F.col("left") / F.col("orig")).otherwise(1.0)
    return occ.join(joined.select("y", "x", loss(share, profile).alias("response")), ["y", "x"]).select("y", "x", "feature", (F.col("value") * F.col("response")).alias("loss"))


def buffer_quality_loss(occ: DataFrame, now: DataFrame, before: DataFrame, radius: int, profile: list[tuple[float, float]]) -> DataFrame:
    """What each cell's removal takes from its neighbours: v (g(k/o) - g((k-1)/o)), summed by cell and feature."""
    ring = [o for o in box(radius) if o != (0, 0)]
    joined = counted(now, ring, "left").join(counted(before, ring, "orig"), ["y", "x"]).where("orig > 0 AND left > 0")
    fall = loss(F.col("left") / F.col("orig"), profile) - loss((F.col("left") - 1) / F.col("orig"), profile)
    given = occ.join(joined.select("y", "x", fall.alias("fall")), ["y", "x"]).select("y", "x", "feature", (F.col("value") * F.col("fall")).alias("lost"))
    moved = shifted(given, ring).groupBy("y", "x", "feature").agg(F.sum("lost").alias("loss"))
    return moved.join(now.select("y", "x"), ["y", "x"], "left_semi")


def unit_quality_loss(occ: DataFrame, now: DataFrame, before: DataFrame, plu: DataFrame, radius: int, profile: list[tuple[float, float]]) -> DataFrame:
    """plu_id, feature, loss: what a planning unit's removal takes by the boundary's quality.

    Its own cells lose value times response; each cell outside it that has k of the unit's cells within the radius loses
    value times the fall of the response from the neighbours there now to k fewer.
    """
    ring = [o for o in box(radius) if o != (0, 0)]
    own = local_quality_loss(occ, now, before, radius, profile).join(plu, ["y", "x"]).select("plu_id", "feature", "loss")
    units = plu.join(now.select("y", "x"), ["y", "x"], "left_semi")
    # by outside cell and unit: how many of the unit's cells are near
    near = shifted(units, ring).groupBy("y", "x", "plu_id").agg(F.count("*").alias("k"))
    outside = near.join(units.select("y", "x", F.col("plu_id").alias("inside")), ["y", "x"]).where("plu_id <> inside")
    around = counted(now, ring, "left").join(counted(before, ring, "orig"), ["y", "x"]).where("orig > 0")
    fall = loss(F.col("left") / F.col("orig"), profile) - loss((F.col("left") - F.col("k")) / F.col("orig"), profile)
    falls = outside.join(around, ["y", "x"]).select("y", "x", "plu_id", fall.alias("fall"))
    given = occ.where("value > 0").join(falls, ["y", "x"]).select("plu_id", "feature", (F.col("value") * F.col("fall")).alias("loss"))
    return own.unionByName(given).groupBy("plu_id", "feature").agg(F.sum("loss").alias("loss"))


def point_deltas(points: DataFrame, now: DataFrame, rule: str) -> DataFrame:
    """The point features' part of each cell's delta: the largest weighted share for core areas, else the benefit that
    the cell's removal takes, as a difference."""
    joined = points.join(F.broadcast(now), "feature").where("r > 0")
    less = F.greatest(F.col("r") - F.col("value"), F.lit(0.0))
    if rule == "caz":
        found = F.max(F.col("weight") * F.col("value") / F.col("r"))
    elif rule == "gbf":
        p = [F.col(c) for c in ("weight", "tj", "w2", "exp1", "exp2")]
        found = F.sum(rr4(F.col("r"), *p) - rr4(less, *p))
    else:
        p = F.col("sr_par") if rule == "abf" else F.lit(0.25)
        found = F.sum(F.col("weight") * (power(F.col("r"), p) - power(less, p)))
    return joined.groupBy("y", "x").agg(found.alias("delta"))


def split_risk(cells: DataFrame) -> DataFrame:
    """The cells whose removal may split what is around them: over one side neighbour and under seven neighbours."""
    both = counted(cells, NEAR4, "nb4").join(counted(cells, NEAR8, "nb8"), ["y", "x"])
    return both.where("nb4 > 1 AND nb8 < 7")


def domain_coefficient(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """The sum of weight times value over domain layers (y, x, weight, value) at each cell; 1 without any."""
    sums = layers.groupBy("y", "x").agg(F.sum(F.col("weight") * F.col("value")).alias("coefficient"))
    return cells.select("y", "x").join(sums, ["y", "x"], "left").select("y", "x", F.coalesce("coefficient", F.lit(1.0)).alias("coefficient"))
