"""Planning units, trees of them, and administrative units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.benefit import loss
from ..lineage import cut


def unit_boxes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("plu_id").agg(F.count("*").alias("n_cells"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def unit_profiles(occ: DataFrame, cells: DataFrame) -> DataFrame:
    """What each planning unit holds of each feature."""
    return occ.where("value > 0").join(cells.select("y", "x", "plu_id"), ["y", "x"]).groupBy("plu_id", "feature").agg(F.sum("value").alias("value"))


def unit_cost(cells: DataFrame, cost: DataFrame) -> DataFrame:
    return cells.join(cost, ["y", "x"]).groupBy("plu_id").agg(F.sum("cost").alias("cost"))


def alignment(cells: DataFrame, occ: DataFrame) -> DataFrame:
    """Cells that only one of planning units and occurrences has."""
    unit = cells.where("plu_id IS NOT NULL").select("y", "x", F.lit(1).alias("unit"))
    data = occ.select("y", "x").distinct().withColumn("data", F.lit(1))
    joined = unit.join(data, ["y", "x"], "full_outer")
    return joined.agg(F.count_if(F.col("unit").isNull()).alias("without_unit"), F.count_if(F.col("data").isNull()).alias("without_data"))


def checked_tree(tree: DataFrame) -> DataFrame:
    """Links to itself or to an unknown unit become links to the sea."""
    known = tree.select(F.col("id").alias("known"))
    joined = tree.join(known, tree.down_id == F.col("known"), "left")
    sea = F.col("known").isNull() | (F.col("id") == F.col("down_id"))
    return joined.select("id", F.when(sea, F.lit(-1)).otherwise(F.col("down_id")).alias("down_id"))


def closure(tree: DataFrame, most: int = 64) -> DataFrame:
    """Every unit with every unit downstream of it, by doubling: (id, below, depth); a cycle is an error."""
    paths = checked_tree(tree).where("down_id <> -1").select("id", F.col("down_id").alias("below"), F.lit(1).alias("depth"))
    for _ in range(most):
        ahead = paths.select(F.col("id").alias("below"), F.col("below").alias("further"), F.col("depth").alias("more"))
        longer = paths.join(ahead, "below").select("id", F.col("further").alias("below"), (F.col("depth") + F.col("more")).alias("depth"))
        merged = cut(paths.union(longer).groupBy("id", "below").agg(F.min("depth").alias("depth")))
        if merged.where("id = below").limit(1).count():
            raise ValueError("the tree has a cycle")
        if merged.count() == paths.count():
            return merged
        paths = merged
    raise ValueError("the tree is too deep")


def basins(tree: DataFrame) -> DataFrame:
    """The root of each unit."""
    sound = checked_tree(tree)
    roots = sound.where("down_id = -1").select(F.col("id").alias("root"))
    below = closure(tree).join(roots, F.col("below") == F.col("root")).select("id", "root")
    return below.union(roots.select(F.col("root").alias("id"), "root"))


def upstream_amounts(tree: DataFrame, profiles: DataFrame) -> DataFrame:
    """What lies at and above each unit, by feature."""
    every = closure(tree).select("id", F.col("below").alias("at")).union(tree.select("id", F.col("id").alias("at")))
    return every.join(profiles, every.id == profiles.plu_id).groupBy(F.col("at").alias("plu_id"), "feature").agg(F.sum("value").alias("value"))


def downstream_counts(tree: DataFrame) -> DataFrame:
    below = closure(tree).groupBy("id").agg(F.count("*").alias("below"))
    return tree.select("id").join(below, "id", "left").select("id", F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def upstream_counts(tree: DataFrame) -> DataFrame:
    above = closure(tree).groupBy(F.col("below").alias("id")).agg(F.count("*").alias("above"))
    return tree.select("id").join(above, "id", "left").select("id", F.coalesce("above", F.lit(0)).cast("long").alias("above"))


def connectivity(tree: DataFrame, sizes: DataFrame, left: DataFrame) -> DataFrame:
    """id, up0, up, down0, down: cells in the units above and below each, at first and of the units that are ``left``."""
    held = sizes.join(left.select(F.col("id").alias("plu_id")).withColumn("here", F.lit(1)), "plu_id", "left").select("plu_id", "n_cells", (F.col("n_cells") * F.coalesce("here", F.lit(0))).alias("now"))
    paths = closure(tree).select("id", "below")
    above = paths.join(held, paths.id == held.plu_id).groupBy(F.col("below").alias("id")).agg(F.sum("n_cells").alias("up0"), F.sum("now").alias("up"))
    below = paths.join(held, paths.below == held.plu_id).groupBy("id").agg(F.sum("n_cells").alias("down0"), F.sum("now").alias("down"))
    every = tree.select("id").join(above, "id", "left").join(below, "id", "left")
    return every.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("up0", "up", "down0", "down")))


def tree_loss(tree: DataFrame, profiles: DataFrame, sizes: DataFrame, left: DataFrame, up: list[tuple[float, float]], down: list[tuple[float, float]]) -> DataFrame:
    """plu_id, feature, loss: what the removal of each unit that is ``left`` takes of each feature by a tree's connectivity.

    A unit's value counts by the responses to the shares of what was above and below it that are still there; one
    with nothing above or below at first counts in full.  The unit itself loses that; units below it lose the fall of the
    response ``up`` as it goes, units above it that of the response ``down``.
    """
    here = connectivity(tree, sizes, left).join(left.select("id"), "id", "left_semi")
    held = here.join(sizes.withColumnRenamed("plu_id", "id"), "id")

    def response(kind: str, points: list[tuple[float, float]], taken: str | None = None):
        now = F.col(kind) - F.col(taken) if taken else F.col(kind)
        return F.when(F.col(f"{kind}0") > 0, loss(now / F.col(f"{kind}0"), points)).otherwise(0.0 if taken else 1.0)

    own = held.select("id", F.col("id").alias("of"), (response("up", up) * response("down", down)).alias("share"))
    paths = closure(tree).select("id", "below").join(left.select("id"), "id", "left_semi").join(left.select(F.col("id").alias("below")), "below", "left_semi")
    taken = sizes.select(F.col("plu_id").alias("goes"), F.col("n_cells").alias("taken"))
    under = paths.select(F.col("id").alias("goes"), F.col("below").alias("id")).join(taken, "goes").join(here, "id")
    lower = under.select(F.col("goes").alias("id"), F.col("id").alias("of"), (response("down", down) * (response("up", up) - response("up", up, "taken"))).alias("share"))
    over = paths.select(F.col("below").alias("goes"), "id").join(taken, "goes").join(here, "id")
    upper = over.select(F.col("goes").alias("id"), F.col("id").alias("of"), (response("up", up) * (response("down", down) - response("down", down, "taken"))).alias("share"))
    shares = own.union(lower).union(upper)
    return shares.join(profiles.withColumnRenamed("plu_id", "of"), "of").groupBy(F.col("id").alias("plu_id"), "feature").agg(F.sum(F.col("value") * F.col("share")).alias("loss"))


def representation(occ: DataFrame, cells: DataFrame) -> DataFrame:
    """The share of each feature in each administrative unit."""
    sums = occ.groupBy("feature").agg(F.sum("value").alias("total"))
    parts = occ.join(cells.select("y", "x", "admu"), ["y", "x"]).groupBy("admu", "feature").agg(F.sum("value").alias("value"))
    return parts.join(F.broadcast(sums), "feature").select("admu", "feature", (F.col("value") / F.col("total")).alias("share"))


def counts(cells: DataFrame, cost: DataFrame) -> DataFrame:
    return cells.join(cost, ["y", "x"]).groupBy("admu").agg(F.count("*").alias("n_cells"), F.sum("cost").alias("cost"))


def combined_weights(features: DataFrame, own: DataFrame, units: DataFrame, mode: int = 1) -> DataFrame:
    """Weights by feature and unit: g (l wL + (1 - l) w) in mode 1, g wL in mode 2."""
    joined = own.join(F.broadcast(features.select("feature", "weight")), "feature").join(F.broadcast(units), "admu")
    local = F.col("local_w")
    mixed = F.col("global_w") * (local * F.col("w") + (1 - local) * F.col("weight")) if mode == 1 else F.col("global_w") * F.col("w")
    return joined.select("admu", "feature", mixed.alias("weight"))


def regional_deltas(occ: DataFrame, cells: DataFrame, features: DataFrame, own: DataFrame, units: DataFrame, mode: int, gamma: float = 0.5) -> DataFrame:
    """Core-area deltas with weights by unit (mode 1), or gamma global + (1 - gamma) regional / number of units (mode 2)."""
    weights = combined_weights(features, own, units, mode)
    sums = occ.groupBy("feature").agg(F.sum("value").alias("r"))
    rows = occ.join(cells.select("y", "x", "admu"), ["y", "x"]).join(F.broadcast(sums), "feature")
    if mode == 1:
        joined = rows.join(F.broadcast(weights), ["admu", "feature"])
        return joined.groupBy("y", "x").agg(F.max(F.col("weight") * F.col("value") / F.col("r")).alias("delta"))
    regional = rows.groupBy("admu", "feature").agg(F.sum("value").alias("ra"))
    joined = rows.join(F.broadcast(weights.withColumnRenamed("weight", "wa")), ["admu", "feature"]).join(F.broadcast(regional), ["admu", "feature"]).join(F.broadcast(features.select("feature", "weight")), "feature")
    n = units.agg(F.count("*").alias("n"))
    found = joined.groupBy("y", "x").agg(F.max(F.col("weight") * F.col("value") / F.col("r")).alias("g"), F.max(F.col("wa") * F.col("value") / F.col("ra")).alias("l"))
    return found.crossJoin(F.broadcast(n)).select("y", "x", (gamma * F.col("g") + (1 - gamma) * F.col("l") / F.col("n")).alias("delta"))


def redistributed(rank: DataFrame, cells: DataFrame) -> DataFrame:
    """Ranks within each administrative unit: i/n by global rank."""
    own = Window.partitionBy("admu")
    joined = rank.join(cells.select("y", "x", "admu"), ["y", "x"])
    return joined.select("y", "x", "admu", (F.row_number().over(own.orderBy("step")) / F.count("*").over(own)).alias("rank"))


def area_ranks(rank: DataFrame, cells: DataFrame, area: DataFrame) -> DataFrame:
    """Ranks by area: the share of a unit's area removed up to and with the cell."""
    own = Window.partitionBy("admu")
    joined = rank.join(cells.select("y", "x", "admu"), ["y", "x"]).join(area.select("y", "x", F.col("cost").alias("area")), ["y", "x"])
    return joined.select("y", "x", "admu", (F.sum("area").over(own.orderBy("step")) / F.sum("area").over(own)).alias("rank"))


def curves(occ: DataFrame, cells: DataFrame, order: DataFrame, features: DataFrame, parts: int, by_group: bool = False, by_feature: bool = False) -> DataFrame:
    """By unit (and group, or feature) at ``parts`` equal snapshots of the ranking: min, mean, max and weighted mean of what is left."""
    n = order.agg(F.count("*").alias("n"))
    rows = occ.join(cells.select("y", "x", "admu"), ["y", "x"]).join(order.select("y", "x", "step"), ["y", "x"]).crossJoin(F.broadcast(n))
    part = F.ceil(F.col("step") * parts / F.col("n")).cast("int")
    sums = rows.groupBy("admu", "feature", part.alias("part")).agg(F.sum("value").alias("value"))
    every = sums.groupBy("admu", "feature").agg(F.sum("value").alias("total")).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    joined = every.join(sums, ["admu", "feature", "part"], "left")
    lost = F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy("admu", "feature").orderBy("part"))
    left = joined.withColumn("repr", 1 - lost / F.col("total")).join(F.broadcast(features.select("feature", "weight", "grp")), "feature").where("weight >= 0")
    keys = ["admu", "part", *(["grp"] if by_group else []), *(["feature"] if by_feature else [])]
    return left.groupBy(*keys).agg(F.min("repr").alias("min_rem"), F.avg("repr").alias("mean_rem"), F.max("repr").alias("max_rem"), (F.sum(F.col("repr") * F.col("weight")) / F.sum("weight")).alias("wmean_rem"))
