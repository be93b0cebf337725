"""Layer transforms: each takes the occurrence table and gives it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OCC = ("y", "x", "feature", "value")


def totals(occ: DataFrame, name: str = "total") -> DataFrame:
    """The sum of each feature, a small table: sums are taken before the shuffle."""
    return occ.groupBy("feature").agg(F.sum("value").alias(name))


def normalise(occ: DataFrame) -> DataFrame:
    """Every feature sums to 1; one without a positive sum stays as it is."""
    joined = occ.join(F.broadcast(totals(occ)), "feature")
    return joined.select("y", "x", "feature", F.when(F.col("total") > 0, F.col("value") / F.col("total")).otherwise(F.col("value")).alias("value"))


def rescale(occ: DataFrame, before: DataFrame) -> DataFrame:
    """Every feature gets back its sum in ``before``."""
    joined = occ.join(F.broadcast(totals(occ, "now")), "feature").join(F.broadcast(totals(before, "then")), "feature")
    return joined.select("y", "x", "feature", F.when(F.col("now") != 0, F.col("value") * F.col("then") / F.col("now")).otherwise(F.col("value")).alias("value"))


def masked(occ: DataFrame, mask: DataFrame) -> DataFrame:
    """Only cells whose mask is over 0; NaN is missing."""
    return occ.where(~F.isnan("value")).join(mask.where("mask > 0").select("y", "x"), ["y", "x"], "left_semi")


def area_weighted(occ: DataFrame, area: DataFrame) -> DataFrame:
    return occ.join(area.select("y", "x", "area"), ["y", "x"]).select("y", "x", "feature", (F.col("value") * F.col("area")).alias("value"))


def infogap(occ: DataFrame, beta: DataFrame, weights: DataFrame, alpha: float, proportional: bool = False, logit: bool = False) -> DataFrame:
    """Distribution discounting by uncertainty ``beta``; a cell without one has 1.  Adds ``retained``, the share kept.

    With ``logit`` values are log-odds: the discount is absolute, unscaled and unclamped, and values come back
    through the logistic function.
    """
    joined = occ.join(F.broadcast(totals(occ)), "feature").join(F.broadcast(weights.select("feature", "weight")), "feature").join(beta.select("y", "x", "beta"), ["y", "x"], "left")
    cut = F.coalesce("beta", F.lit(1.0)) * alpha * F.col("weight")
    if logit:
        odds = F.exp(F.col("value") - cut)
        kept = odds / (1 + odds)
    elif proportional:
        kept = F.greatest(F.col("value") * (1 - cut / F.col("total")), F.lit(0.0))
    else:
        kept = F.greatest(F.col("value") - cut / F.col("total"), F.lit(0.0))
    found = joined.select("y", "x", "feature", kept.alias("kept"), "total")
    sums = found.groupBy("feature").agg(F.sum("kept").alias("sum"))
    return found.join(F.broadcast(sums), "feature").select("y", "x", "feature", (F.col("kept") / F.col("sum")).alias("value"), (F.col("sum") / F.col("total")).alias("retained"))


def logistic(occ: DataFrame, scale: float = 1.0) -> DataFrame:
    odds = F.exp(F.col("value") * scale)
    return normalise(occ.select("y", "x", "feature", (odds / (1 + odds)).alias("value")))


def mean_normalised(layer: DataFrame, name: str) -> DataFrame:
    """A layer over the mean of its non-negative cells."""
    mean = layer.where(F.col(name) >= 0).agg(F.avg(name).alias("mean"))
    return layer.crossJoin(F.broadcast(mean)).select("y", "x", (F.col(name) / F.col("mean")).alias(name))


def conditioned(occ: DataFrame, features: DataFrame, group: int, condition: DataFrame) -> DataFrame:
    """Features of a group times the condition; where that is missing the value stays."""
    joined = occ.join(F.broadcast(features.select("feature", "grp")), "feature").join(condition.select("y", "x", "cond"), ["y", "x"], "left")
    return joined.select("y", "x", "feature", F.when(F.col("grp") == group, F.col("value") * F.coalesce("cond", F.lit(1.0))).otherwise(F.col("value")).alias("value"))


def retained(occ: DataFrame, features: DataFrame, group: int, retention: DataFrame) -> DataFrame:
    """Features of a group times 1 - retention; where that is missing the value stays."""
    return conditioned(occ, features, group, retention.select("y", "x", (1 - F.col("ret")).alias("cond")))


def retention_weights(occ: DataFrame, features: DataFrame, group: int, retention: DataFrame, relative: float = 1.0) -> DataFrame:
    """New weights of a group's features from what retention takes: by loss, and by gain."""
    own = features.where(F.col("grp") == group)
    joined = occ.join(F.broadcast(own.select("feature")), "feature").join(retention.select("y", "x", "ret"), ["y", "x"], "left")
    ret = F.coalesce("ret", F.lit(0.0))
    sums = joined.groupBy("feature").agg(F.sum(F.col("value") * ret).alias("lost"), F.sum(F.col("value") * (1 - ret)).alias("remains"))
    weight = F.col("weight") * relative * F.col("lost")
    return own.join(sums, "feature").select("feature", "lost", "remains", (weight / F.col("remains")).alias("by_loss"), (weight / (F.col("remains") + F.col("lost"))).alias("by_gain"))


def edge_corrected(occ: DataFrame, edge: DataFrame) -> DataFrame:
    """Values over 1 - edge, with every feature's sum kept."""
    raised = occ.join(edge.select("y", "x", "edge"), ["y", "x"], "left").select("y", "x", "feature", (F.col("value") / (1 - F.coalesce("edge", F.lit(0.0)))).alias("value"))
    return rescale(raised, occ)


def similar(occ: DataFrame, matrix: DataFrame) -> DataFrame:
    """A community: feature i becomes the sum of all features j, weighted by ``matrix(i, j, w)``, normalised."""
    mixed = occ.join(F.broadcast(matrix), occ.feature == matrix.j).groupBy("y", "x", F.col("i").alias("feature")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return normalise(mixed)


def omitted(occ: DataFrame, percent: float, first_features: int) -> DataFrame:
    """The running-share rule: in the order of y, x, feature, an occurrence is zeroed while the share zeroed so
    far isn't over ``percent``; features get back their sums.

    After k occurrences  floor(p (k - 1)) + 1  are zeroed, so each is decided by its number alone.
    """
    p = percent / 100
    low = occ.where(F.col("feature") < first_features)
    rows = low.groupBy("y").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = rows.select("y", before.alias("before"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("y").orderBy("x", "feature"))
    zero = (k == 1) | (F.floor((k - 1) * p) > F.floor((k - 2) * p))
    decided = low.join(shifts, "y").withColumn("value", F.when(zero, 0.0).otherwise(F.col("value"))).select(*OCC)
    return rescale(decided.unionByName(occ.where(F.col("feature") >= first_features).select(*OCC)), occ)


def weights_rescaled(features: DataFrame) -> DataFrame:
    """Weights over the largest absolute weight."""
    top = features.agg(F.max(F.abs("weight")).alias("top"))
    return features.crossJoin(F.broadcast(top)).withColumn("weight", F.col("weight") / F.col("top")).drop("top")


def subsampled(features: DataFrame, n: int, seed: int) -> DataFrame:
    """n features without replacement, the same for the same seed."""
    return features.orderBy(F.xxhash64("feature", F.lit(seed)), "feature").limit(n)


def occurring(features: DataFrame, occ: DataFrame) -> DataFrame:
    return features.join(occ.select("feature"), "feature", "left_semi")


def positive_cells(occ: DataFrame, features: DataFrame) -> DataFrame:
    """Occurrences of cells whose largest weighted value is over 0."""
    top = occ.join(F.broadcast(features.select("feature", "weight")), "feature").groupBy("y", "x").agg(F.max(F.col("value") * F.col("weight")).alias("top"))
    return occ.join(top.where("top > 0"), ["y", "x"], "left_semi")


def filled(occ: DataFrame, features: DataFrame) -> DataFrame:
    """Every present cell has every feature, 0 where it was missing."""
    every = occ.select("y", "x").distinct().crossJoin(F.broadcast(features.select("feature")))
    return every.join(occ, ["y", "x", "feature"], "left").select("y", "x", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


def sane_cost(cost: DataFrame) -> DataFrame:
    """Costs that aren't over 0 become 1; ``replaced`` says where."""
    ok = F.coalesce(F.col("cost") > 0, F.lit(False))
    return cost.select("y", "x", F.when(ok, F.col("cost")).otherwise(F.lit(1.0)).alias("cost"), (~ok).alias("replaced"))


def cell_cost(cells: DataFrame, cost: DataFrame | None, area: DataFrame | None) -> DataFrame:
    """The cost of each cell: its cost, else its area, else 1."""
    out, terms = cells.select("y", "x"), []
    for layer, name in ((cost, "cost"), (area, "area")):
        if layer is not None:
            out = out.join(layer.select("y", "x", F.col(name).alias(f"own_{name}")), ["y", "x"], "left")
            terms.append(F.col(f"own_{name}"))
    return out.select("y", "x", F.coalesce(*terms, F.lit(1.0)).alias("cost"))


def richness(occ: DataFrame, features: DataFrame) -> DataFrame:
    """Weighted richness of each cell: the sum of weight times value, negative values left out."""
    return occ.join(F.broadcast(features.select("feature", "weight")), "feature").groupBy("y", "x").agg(F.sum(F.greatest(F.col("value"), F.lit(0.0)) * F.col("weight")).alias("wrscr"))


def largest(occ: DataFrame, features: DataFrame, cost: DataFrame) -> DataFrame:
    """The largest weighted value of each cell over its cost."""
    top = occ.join(F.broadcast(features.select("feature", "weight")), "feature").groupBy("y", "x").agg(F.max(F.col("value") * F.col("weight")).alias("top"), F.sum(F.col("value") * F.col("weight")).alias("sum"))
    return top.join(cost, ["y", "x"]).select("y", "x", (F.col("top") / F.col("cost")).alias("rmax"), (F.col("sum") / F.col("cost")).alias("rsum"))


def richness_maps(occ: DataFrame, features: DataFrame) -> DataFrame:
    """Four richness maps of each cell: occurrences and levels, plain and weighted."""
    joined = occ.join(F.broadcast(features.select("feature", "weight")), "feature").where("value > 0")
    return joined.groupBy("y", "x").agg(F.count("*").alias("occurrences"), F.sum("weight").alias("weighted_occurrences"), F.sum("value").alias("level"), F.sum(F.col("value") * F.col("weight")).alias("weighted_level"))


def centroids(occ: DataFrame) -> DataFrame:
    mean = lambda c: F.sum(F.col("value") * F.col(c)) / F.sum("value")
    return occ.groupBy("feature").agg(F.sum("value").alias("total"), mean("x").alias("cx"), mean("y").alias("cy"))


def statistics(layer: DataFrame, name: str) -> DataFrame:
    return layer.agg(F.count(name).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"), F.avg(name).alias("mean"), F.stddev_pop(name).alias("deviation"))


def cell_size_alphas(features: DataFrame, occ: DataFrame, area: DataFrame) -> DataFrame:
    """Kernel parameters where cells differ in size: alpha times sqrt(area at the feature's centre) over sqrt(largest area).
    A centre without an area keeps its alpha."""
    top = area.agg(F.max("area").alias("top"))
    middle = centroids(occ).select("feature", F.floor(F.col("cy") + 0.5).cast("int").alias("y"), F.floor(F.col("cx") + 0.5).cast("int").alias("x"))
    joined = features.join(middle, "feature").join(area.select("y", "x", "area"), ["y", "x"], "left").crossJoin(F.broadcast(top))
    return joined.select("feature", (F.col("alpha") * F.sqrt(F.coalesce("area", "top")) / F.sqrt("top")).alias("alpha"))


def cost_report(cost: DataFrame, cells: DataFrame) -> DataFrame:
    """Cost on the cells with data and on others, and the cells with data whose cost isn't over 0 or is missing."""
    joined = cost.join(cells.select("y", "x").withColumn("here", F.lit(True)), ["y", "x"], "full_outer")
    here, good = F.col("here").isNotNull(), F.coalesce(F.col("cost") > 0, F.lit(False))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("cost"))), F.lit(0.0))
    return joined.agg(total(here).alias("inside"), total(~here).alias("outside"), F.count_if(here & ~good).alias("bad_cells"))


def density_report(occ: DataFrame) -> DataFrame:
    """How many occurrences, cells and features there are, features of a cell on average and at most, and the share of all
    cells times features that is filled."""
    by = occ.groupBy("y", "x").agg(F.count("*").alias("n"))
    cells = by.agg(F.sum("n").alias("occurrences"), F.count("*").alias("cells"), F.avg("n").alias("mean_features"), F.max("n").alias("most_features"))
    kinds = occ.groupBy("feature").count().agg(F.count("*").alias("features"))
    return cells.crossJoin(kinds).withColumn("filled", F.col("occurrences") / (F.col("cells") * F.col("features")))
