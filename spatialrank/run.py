"""A whole run: settings, lists and grids in; a ranking, its curves, maps, reports and analyses out.

``prepare`` loads a landscape and transforms it in the fixed order (uncertainty, smoothing, community similarity,
condition, retention, matrix connectivity, interactions), ``execute`` ranks it or replays a given ranking, and ``write``
puts every output below a folder.  Paths in lists and settings are taken from the folder of the file that names them.
A part of the settings that no operator has (tree connectivity, planning units together with penalties, local edge
corrections as a file of their own) is an error, never passed over.
"""

from __future__ import annotations

import logging
import posixpath
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .landscape import Grid, present
from .lineage import numbered
from .operators import analyses, curves, focal, greedy, regions
from .operators import transforms as t
from .sources import grids, lists
from .streaming import progress

log = logging.getLogger("spatialrank.run")
#: A landscape of at most so many occurrences may be ranked in one task.
SMALL = 5_000_000


@dataclass
class Prepared:
    """A landscape ready to be ranked; ``stages`` has the occurrences after each transform that the settings ask for."""

    settings: config.Settings
    grid: Grid
    occ: DataFrame
    features: DataFrame
    cost: DataFrame | None = None
    levels: DataFrame | None = None
    admu: dict[str, DataFrame] = field(default_factory=dict)
    plu: DataFrame | None = None
    stages: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Outcome:
    """The order (y, x, step, rank) and the tables made from it."""

    prepared: Prepared
    order: DataFrame
    tables: dict[str, DataFrame]
    maps: dict[str, tuple[DataFrame, str]]


def _beside(path: str, name: str) -> str:
    return name if posixpath.isabs(name) or "://" in name else posixpath.join(posixpath.dirname(path), name)


def read_settings(spark: SparkSession, run: config.Run) -> config.Settings:
    """The settings file of a run, with the options of its command line over it."""
    row = spark.read.text(run.settings, wholetext=True).first()
    found = config.settings(row.value if row else "")
    for notice in found.notices:
        log.warning("%s: %s", run.settings, notice)
    for key, value in (("removal rule", run.rule), ("warp factor", run.warp)):
        if value is not None:
            found.values["settings", key] = value
    if found.get("use tree connectivity") or found.get("use local edge corrections"):
        raise ValueError("tree connectivity and local edge corrections aren't part of a run")
    return found


def _features(spark: SparkSession, run: config.Run, found: config.Settings) -> DataFrame:
    """The feature list with the columns that the rules read; weights over the largest."""
    rows = lists.feature_list(spark, run.features, True if found.rule == "gbf" else None)
    have = rows.columns
    exponent = F.col("exponent") if "exponent" in have else F.lit(0.25)
    other = lambda name, value: (F.col(name) if name in have else F.lit(value)).alias(name)
    target = F.col("tj") if "tj" in have else exponent
    rows = rows.select("feature", F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("name"), "weight", "alpha", "profile", "radius", exponent.alias("sr_par"), target.alias("tj"), other("w2", 1.0), other("exp1", 0.5), other("exp2", 0.25), "path")
    if found.get("use groups"):
        own = lists.groups(spark, _beside(run.settings, found.get("groups file")), rows.count())
        rows = rows.join(own, "feature").withColumnRenamed("grp_out", "grp")
    else:
        rows = rows.withColumn("grp", F.lit(0))
    if found.get("resample species"):
        rows = t.subsampled(rows, found.get("resample species"), 0)
    return t.weights_rescaled(rows)


def _uncertain(spark: SparkSession, run: config.Run, found: config.Settings, occ: DataFrame, features: DataFrame, grid: Grid) -> DataFrame:
    section = "Info-gap settings"
    weights = features.select("feature", F.lit(1.0).alias("weight"))
    beta = occ.select("y", "x").distinct().withColumn("beta", F.lit(1.0))
    if found.get("use info-gap weights", section):
        path = _beside(run.settings, found.get("Info-gap weights file", section))
        layers = [(w, _beside(path, p)) for w, p in lists.weighted_paths(spark, path)]
        beta = grids.read_grid(spark, layers[0][1], "beta", grid)
        if found.get("normalize info-gap weights", section):
            beta = t.mean_normalised(beta, "beta")
    return t.infogap(occ, beta, weights, run.alpha, found.get("Info-gap proportional", section), found.get("logit space"))


def _grouped(spark: SparkSession, run: config.Run, found: config.Settings, key: str, grid: Grid, name: str) -> list[tuple[int, DataFrame]]:
    path = _beside(run.settings, found.get(key))
    return [(int(g), grids.read_grid(spark, _beside(path, p), name, grid)) for g, p in lists.weighted_paths(spark, path)]


def _spread(grid: Grid, alpha: float):
    """The exponential kernel over the whole grid; alpha is by map unit, a cell ``cs`` of them wide."""
    return focal.whole_grid(grid.yd, grid.xd, lambda d: np.exp(-alpha * grid.cs * d) / (2 * np.pi * (alpha * grid.cs) ** 2))


def _smoothed(occ: DataFrame, features: DataFrame, grid: Grid, multiplier: float) -> DataFrame:
    alphas = {r.alpha for r in features.select("alpha").distinct().collect()}
    parts = []
    for alpha in sorted(alphas):
        own = occ.join(F.broadcast(features.where(F.col("alpha") == alpha).select("feature")), "feature", "left_semi")
        parts.append(focal.smoothed(own, _spread(grid, alpha * multiplier)) if alpha > 0 else own)
    return reduce(DataFrame.unionByName, (p.select(*t.OCC) for p in parts))


def prepare(spark: SparkSession, run: config.Run) -> Prepared:
    """Load what the run names and transform it."""
    found = read_settings(spark, run)
    features = _features(spark, run, found)
    listed = {r.feature: _beside(run.features, r.path) for r in features.select("feature", "path").collect()}
    features = features.drop("path")
    if not listed:
        raise ValueError(f"{run.features}: no features")
    grid, _ = grids.read_header(spark, listed[min(listed)])
    layer = lambda key, name, section="Settings": grids.read_grid(spark, _beside(run.settings, found.get(key, section)), name, grid)
    load = found.get("load vmat", "vmat")
    if load:
        occ = grids.load_occurrences(spark, _beside(run.settings, load), grid)
    else:
        occ = reduce(DataFrame.unionByName, (grids.read_grid(spark, p, expect=grid).where("value >= 0").select("y", "x", F.lit(i).alias("feature"), "value") for i, p in sorted(listed.items())))
    if found.get("mask missing areas"):
        occ = t.masked(occ, layer("area mask file", "mask"))
    area = layer("cell area layer", "area") if found.get("cell area layer") else None
    if area is not None:
        occ = t.area_weighted(occ, area.where("area > 0") if found.get("treat zero-areas as missing data") else area)
    stages: dict[str, DataFrame] = {}

    def stage(name: str, changed: DataFrame) -> DataFrame:
        if found.get(f"output {name} transformed layers", "Transformed layers"):
            stages[name] = changed
        return changed

    if run.alpha or found.get("logit space"):
        occ = stage("info-gap", _uncertain(spark, run, found, occ, features, grid).select(*t.OCC))
    else:
        occ = t.normalise(occ)
    if run.smoothing:
        occ = stage("distribution smoothing", _smoothed(occ, features, grid, run.kernel_multiplier))
    community = "Community analysis settings"
    if found.get("apply to representation", community):
        matrix = lists.matrix(spark, _beside(run.settings, found.get("community similarity matrix file", community)), len(listed))
        occ = stage("community similarity", t.similar(occ, matrix))
    if found.get("use condition layer"):
        own = features.select("feature", F.col("grp_cond").alias("grp"))
        for group, condition in _grouped(spark, run, found, "condition file", grid, "cond"):
            occ = t.conditioned(occ, own, group, condition)
        occ = stage("condition", occ)
    if found.get("use retention layer"):
        own = features.select("feature", "weight", F.col("grp_ret").alias("grp"))
        for group, retention in _grouped(spark, run, found, "retention file", grid, "ret"):
            changed = t.retention_weights(occ, own, group, retention, found.get("retention layers relative weight"))
            gain = F.when(F.col("ret_mode") == 2, F.col("by_gain")).otherwise(F.col("by_loss"))
            features = features.join(F.broadcast(changed), "feature", "left").withColumn("weight", F.coalesce(gain, "weight")).drop("lost", "remains", "by_loss", "by_gain")
            occ = t.retained(occ, own, group, retention)
        occ = stage("retention", occ)
    if found.get("apply to connectivity", community):
        matrix = lists.matrix(spark, _beside(run.settings, found.get("connectivity similarity matrix file", community)), len(listed))
        alpha = features.agg(F.max("alpha")).first()[0] * run.kernel_multiplier
        occ = stage("matrix connectivity", focal.connected(occ, matrix, _spread(grid, alpha)))
    if found.get("use interactions"):
        for resource, consumer, alpha, kind, gamma in lists.interactions(spark, _beside(run.settings, found.get("interaction file"))):
            change = focal.attracted if kind == 1 else focal.avoided
            changed = change(occ, resource, consumer, _spread(grid, alpha), gamma)
            occ = occ.where(F.col("feature") != resource).select(*t.OCC).unionByName(changed.select(*t.OCC))
        occ = stage("interactions", occ)
    if percent := found.get("random omission percentage after vmat simple impl"):
        occ = t.omitted(occ, percent, found.get("random omission max feature") or len(listed))
    occ = stage("final", occ.select(*t.OCC))
    if found.get("drop 0 occurrence layers"):
        features = t.occurring(features, occ)
    if found.get("use SSI"):
        occ, features = _with_points(spark, run, found, occ, features, grid)
    cells = present(occ)
    cost = t.cell_cost(cells, layer("cost file", "cost") if found.get("use cost") else None, area)
    priced = t.sane_cost(cost) if found.get("use cost") or area is not None else None
    out = Prepared(found, grid, occ, features, priced, stages=stages)
    if found.get("use mask"):
        out.levels = cells.join(layer("mask file", "mask_level"), ["y", "x"], "left").select("y", "x", F.coalesce(F.col("mask_level").cast("int"), F.lit(0)).alias("mask_level"))
    units = "Administrative units"
    if found.get("use ADMUs", units):
        described = lists.admin_units(spark, _beside(run.settings, found.get("ADMU descriptions file", units)))
        weights = lists.admin_weights(spark, _beside(run.settings, found.get("ADMU weight matrix", units)), [r.admu for r in described.collect()])
        placed = layer("ADMU layer file", "admu", units).select("y", "x", F.col("admu").cast("int").alias("admu"))
        unknown = lists.unknown_units(placed, described).limit(3).collect()
        if unknown:
            raise ValueError(f"units without a description: {[r.admu for r in unknown]}")
        out.admu = {"cells": placed.join(cells, ["y", "x"], "left_semi"), "weights": weights, "units": described.select("admu", "global_w", "local_w")}
    if found.get("use planning unit layer"):
        out.plu = layer("planning unit layer file", "plu_id").select("y", "x", F.col("plu_id").cast("int").alias("plu_id")).join(cells, ["y", "x"], "left_semi")
    if path := found.get("save vmat", "vmat"):
        grids.save_occurrences(occ, _beside(run.settings, path))
    return out


def _with_points(spark: SparkSession, run: config.Run, found: config.Settings, occ: DataFrame, features: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Point features join the others, after them; core-area removal only, where a point counts as any occurrence."""
    if found.rule != "caz":
        raise ValueError("point features need the core-area rule")
    path = _beside(run.settings, found.get("SSI file name"))
    top = features.agg(F.max("feature")).first()[0] + 1
    points = lists.feature_list(spark, path)
    own = points.select((F.col("feature") + top).alias("feature"), F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("name"), "weight")
    cells = present(occ)
    for r in points.select("feature", "path").collect():
        occ = occ.unionByName(lists.point_observations(spark, _beside(path, r.path), grid, cells, r.feature + top))
    return occ, features.unionByName(own, allowMissingColumns=True).na.fill({"grp": 0, "sr_par": 0.25, "tj": 0.25, "w2": 1.0, "exp1": 0.5, "exp2": 0.25})


def penalties(run: config.Run, made: Prepared, spark: SparkSession) -> greedy.Penalties:
    """What the settings add to each round's deltas."""
    found = made.settings
    quality = regional = corridor = None
    if found.get("use boundary quality penalty"):
        held = lists.profiles(spark, _beside(run.settings, found.get("BQP profiles file")))
        used = {(int(r.profile), int(r.radius)) for r in made.features.where("profile > 0").select("profile", "radius").distinct().collect()}
        if len(used) > 1:
            raise ValueError("one boundary quality profile and radius for all features is what a ranking takes")
        if used:
            ((profile, radius),) = used
            quality = radius, held[profile]
    if made.admu:
        regional = made.admu["cells"], made.admu["weights"], made.admu["units"], found.get("ADMU mode", "Administrative units")
    section = "Corridor loss penalty"
    if found.get("use corridors", section):
        corridor = made.grid.xd, found.get("strength", section)
    return greedy.Penalties(found.get("BLP"), quality, regional, corridor)


def _ranked(run: config.Run, made: Prepared, spark: SparkSession) -> DataFrame:
    """y, x, step of every cell by greedy removal."""
    found, also = made.settings, penalties(run, made, spark)
    rule, warp, edge = found.rule, found.get("warp factor"), found.get("edge removal")
    if made.plu is not None:
        if also != greedy.Penalties() or made.levels is not None:
            raise ValueError("planning units are ranked without penalties and masks")
        units = greedy.rank_units(made.occ, made.plu, made.features, rule, warp, made.cost)
        rows = made.plu.join(units, "plu_id")
    else:
        first = found.get("initial removal percent")
        occ, early = made.occ, None
        if first:
            worth = t.richness(occ, made.features)
            early = greedy.initial_removal(worth, "wrscr", first).select("y", "x", F.lit(0).alias("round"), F.lit(0).alias("place"))
            occ = occ.join(early.select("y", "x"), ["y", "x"], "left_anti")
        if rule in ("caz", "abf", "random") and also == greedy.Penalties() and occ.limit(SMALL + 1).count() <= SMALL:
            rows = greedy.rank_small(occ, made.features, rule, warp, made.levels, made.cost, whole_blocks=False, neighbours=True, edge_only=edge)
        else:
            rows = greedy.rank(occ, made.features, rule, warp, made.cost, made.levels, edge, also=also)
        rows = rows.unionByName(early) if early is not None else rows
    return numbered(rows.select("y", "x", "round", "place"), [F.col(c) for c in ("round", "place", "y", "x")]).select("y", "x", "step")


def _reloaded(run: config.Run, made: Prepared, spark: SparkSession) -> DataFrame:
    """y, x, step of the cells of a given ranking, in its order; with a mask the lowest level goes first."""
    held = grids.read_grid(spark, run.ranking, "rank", made.grid).join(present(made.occ), ["y", "x"], "left_semi")
    if made.levels is not None:
        held = held.join(made.levels, ["y", "x"])
    else:
        held = held.withColumn("mask_level", F.lit(0))
    return numbered(held, [F.col(c) for c in ("mask_level", "rank", "y", "x")]).select("y", "x", "step")


def execute(spark: SparkSession, run: config.Run) -> Outcome:
    """Rank or replay, and every table and map of it."""
    made = prepare(spark, run)
    steps = _ranked(run, made, spark) if run.mode == "rank" else _reloaded(run, made, spark)
    n = steps.count()
    log.info("%s: %d cells", run.mode, n)
    order = steps.withColumn("rank", F.col("step") / F.lit(float(max(n, 1))))
    return replace(outputs(spark, made, order, n), prepared=made)


def outputs(spark: SparkSession, made: Prepared, order: DataFrame, n: int) -> Outcome:
    """Curves, reports and maps of an order over a landscape."""
    every = curves.snapshots(n)
    marks = order.where((F.col("step") % every == 0) | (F.col("step") == n)).select("step")
    held = curves.at_steps(marks, made.occ, order)
    features = made.features
    cost = made.cost if made.cost is not None else present(made.occ).withColumn("cost", F.lit(1.0))
    tables = {"curves": held, "summary": curves.summary(held, features, made.settings.get("z")), "features": curves.feature_report(made.occ, features, held), "removals": curves.removal_rows(order, cost)}
    maps = {"rank": (order, "rank"), "prop_loss": (curves.loss_map(made.occ, order, features), "prop_loss"), "wrscr": (t.richness(made.occ, features), "wrscr")}
    if made.settings.get("use groups"):
        tables["groups"] = curves.by_group(held, features, made.settings.get("z"))
    if made.admu:
        cells = made.admu["cells"]
        tables["admu_curves"] = regions.curves(made.occ, cells, order, features, made.settings.get("row count for per ADMU output curves", "Administrative units") or 100)
        maps["admu_rank"] = regions.redistributed(order, cells), "rank"
    for key, name in (("output occurrence richness map", "occurrences"), ("output weighted occurrence richness map", "weighted_occurrences"), ("output occurrence level richness map", "level"), ("output weighted occurrence level richness map", "weighted_level")):
        if made.settings.get(key, "Outputs"):
            maps[name] = t.richness_maps(made.occ, features), name
    return Outcome(made, order, tables, maps)


def analyse(spark: SparkSession, run: config.Run, done: Outcome) -> dict[str, DataFrame]:
    """The analyses that the settings' list asks for, by kind and place in the list."""
    name = done.prepared.settings.get("post-processing list file")
    if not name:
        return {}
    path, made, order = _beside(run.settings, name), done.prepared, done.order
    layer = lambda p, column: grids.read_grid(spark, _beside(path, p), column, made.grid)
    out = {}
    for i, a in enumerate(lists.analyses(spark, path)):
        if a["kind"] == "LSI":
            found = analyses.landscape_networks(order, made.occ, made.grid.xd, a["f1"], a["f2"], int(a["distance"]), a["similarity"])
        elif a["kind"] == "LSB":
            mask = layer(a["mask"], "mask").where("mask > 0").select("y", "x")
            found = analyses.landscape_networks(order, made.occ, made.grid.xd, a["f1"], a["f2"], int(a["distance"]), a["similarity"], mask)
        elif a["kind"] == "LSM":
            groups = layer(a["mask"], "unit").select("y", "x", F.col("unit").cast("int").alias("unit")).where("unit > 0")
            found = analyses.unit_report(groups, order, made.occ, "unit")
        else:
            found = analyses.comparison(order, layer(a["compare"], "rank"), a["f1"], a["f2"])
        out[f"{i + 1}_{a['kind']}"] = found
    return out


def write(spark: SparkSession, run: config.Run, done: Outcome) -> None:
    """Every output below the folder that the run names, and its settings; removals go to the progress feed."""
    made, base = done.prepared, f"{run.output}.{config.output_suffix(done.prepared.settings, run)}"
    for name, (layer, column) in done.maps.items():
        grids.write_grid(layer, made.grid, f"{base}.{name}.asc", column)
    for name, table in (done.tables | analyse(spark, run, done)).items():
        grids.save_table(table, f"{base}.{name}.parquet")
    if made.stages:
        grids.save_stages(made.stages, f"{base}.stages")
    progress.publish(done.order.select("y", "x", F.col("step").cast("int").alias("round"), F.lit(1).alias("place")), f"{base}.progress")
    text = [(line,) for line in config.settings_text(made.settings).splitlines()]
    spark.createDataFrame(text, "value string").coalesce(1).write.mode("overwrite").text(f"{base}.settings")


def main(spark: SparkSession, text: str) -> list[Outcome]:
    """The runs of a batch, one after the other."""
    done = []
    for run in config.batch(text):
        done.append(execute(spark, run))
        write(spark, run, done[-1])
    return done
