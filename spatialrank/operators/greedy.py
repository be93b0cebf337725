"""Greedy removal: blocks of the cheapest units until none is left.

A round computes the representation, the delta of every candidate and takes the k smallest by (delta, present
neighbours, y, x); the state is frozen within a round.  Spark drives it from the driver: the representation is
one number for each feature; a round's removals are written to the shared folder, and only their number comes back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, running_sum, shared
from .corridors import fast_penalty
from .focal import NEAR8, counted, edge
from .regions import regional_deltas, unit_cost, unit_profiles
from .rules import boundary_term, buffer_quality_loss, deltas, local_quality_loss, over_cost, random_deltas, state

REMOVALS = "y int, x int, round int, place int"
#: The most removals of a round that are broadcast; a larger round is joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Values (cells times features) of a batch's cheapest cells, which one task holds.
BATCH = 1 << 20


def _cheapest(found: DataFrame, cells: DataFrame, k: int, digits: int = 9) -> DataFrame:
    near = counted(cells, NEAR8, "nb8")
    chosen = found.join(near, ["y", "x"]).withColumn("delta", F.round("delta", digits)).orderBy("delta", "nb8", "y", "x").limit(k)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("delta", "nb8", "y", "x"))).select("y", "x", "delta", "place", "nb8")


def block(found: DataFrame, cells: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k cells with the least delta, ties by fewest present neighbours, then y, x; ``place`` from 1.

    Top-k is kept by each task before the merge.
    """
    return _cheapest(found, cells, k, digits).drop("nb8")


def initial_removal(cells: DataFrame, value: str, percent: float) -> DataFrame:
    """The lowest ``percent`` of the cells by value, ties by y, x."""
    n = int(cells.count() * percent / 100)
    return cells.orderBy(value, "y", "x").limit(n)


@dataclass(frozen=True)
class Penalties:
    """What a round's deltas take in beside the rule.

    ``blp``: the strength of the boundary's length, whose term is subtracted.  ``quality``: (radius, profile) of the
    boundary's quality; units then lose their own and their neighbours' share by it, and representation counts it.
    ``regions``: (cells with admu, own weights, units, mode) of administrative weights, core-area rule only.
    ``corridor``: (width of the grid, strength) of the fast corridor penalty, which is added.
    """

    blp: float = 0.0
    quality: tuple[int, list[tuple[float, float]]] | None = None
    regions: tuple[DataFrame, DataFrame, DataFrame, int] | None = None
    corridor: tuple[int, float] | None = None

    def check(self, rule: str) -> None:
        if self.regions and (rule != "caz" or self.quality):
            raise ValueError("administrative weights need the core-area rule and no boundary quality")


def round_deltas(left: DataFrame, cells: DataFrame, before: DataFrame, features: DataFrame, rule: str, n_features: int, seed: int, cost: DataFrame | None, also: Penalties) -> DataFrame:
    """The delta of every remaining cell: the rule over cost, less the boundary's term, plus the corridor's."""
    if rule == "random":
        found = random_deltas(left, seed)
    elif also.regions:
        admu, own, units, mode = also.regions
        found = regional_deltas(left, admu, features, own, units, mode)
    elif also.quality:
        kept = local_quality_loss(left, cells, before, *also.quality).withColumnRenamed("loss", "value")
        lost = kept.unionByName(buffer_quality_loss(left, cells, before, *also.quality).withColumnRenamed("loss", "value"))
        found = deltas(lost.groupBy("y", "x", "feature").agg(F.sum("value").alias("value")), state(kept, features), rule, n_features)
    else:
        found = deltas(left, state(left, features), rule, n_features)
    if cost is not None:
        found = over_cost(found, cost)
    if also.blp:
        found = found.join(boundary_term(cells, also.blp).select("y", "x", "term"), ["y", "x"]).select("y", "x", (F.col("delta") - F.col("term")).alias("delta"))
    if also.corridor:
        more = fast_penalty(cells, left, *also.corridor).select("y", "x", "penalty")
        found = found.join(more, ["y", "x"], "left").select("y", "x", (F.col("delta") + F.coalesce("penalty", F.lit(0.0))).alias("delta"))
    return found


def _only_rise(occ: DataFrame, features: DataFrame, rule: str, cost: DataFrame | None) -> bool:
    """Whether no delta ever falls as other cells go: shares of what is left of wanted features, slopes of concave benefits,
    fixed numbers."""
    if rule not in ("caz", "abf", "random"):
        return False
    odd = [features.where("weight < 0 OR weight IS NULL OR isnan(weight)" + (" OR sr_par IS NULL OR NOT sr_par BETWEEN 0 AND 1" if rule == "abf" else ""))]
    odd += [occ.where("value IS NULL OR value < 0 OR isnan(value)")] + ([cost.where("cost IS NULL OR NOT cost > 0")] if cost is not None else [])
    return all(rows.isEmpty() for rows in odd)


def _batch(left: DataFrame, pool: DataFrame, features: DataFrame, rule: str, warp: int, whole_blocks: bool, candidates: int, turn: int, cost: DataFrame | None, seed: int) -> DataFrame:
    """The removals of the rounds from ``turn`` on that are settled by ``pool``, the written rows of ``_cheapest`` for the P
    cheapest of ``candidates`` cells."""
    size, bound = pool.agg(F.count("*"), F.max("delta")).first()
    others = left.join(F.broadcast(pool.select("y", "x")), ["y", "x"], "left_anti").groupBy("feature").agg(F.sum("value").alias("r"))
    held = {r.feature: r.r for r in others.collect()}
    outside = candidates - size
    rows = _rows(left.join(F.broadcast(pool.select("y", "x", "nb8")), ["y", "x"]), features, rule, None, cost, seed)

    def played(frame: pd.DataFrame) -> pd.DataFrame:
        found = _kernel(frame, rule, warp, whole_blocks, True, False, held, outside, bound)
        return found.assign(round=found["round"] + turn - 1)

    return rows.groupBy("whole").applyInPandas(played, REMOVALS)


def rank(occ: DataFrame, features: DataFrame, rule: str = "caz", warp: int = 1, cost: DataFrame | None = None, levels: DataFrame | None = None, edge_only: bool = False, seed: int = 0, whole_blocks: bool = False, every: int = 4, also: Penalties = Penalties(), batch: int = BATCH) -> DataFrame:
    """y, x, round, place for every cell, removed in rounds of k = max(1, min(warp, candidates // 100)).

    ``whole_blocks`` takes k = warp as it is.  With ``levels`` (y, x, mask_level) the lowest level goes first.  Every few
    rounds the remaining table is checkpointed to the shared folder.  ``also`` are penalties and weights of each round.
    Where deltas only rise and a round is under a quarter of ``batch`` values, rounds go in batches; 0 is without any.
    """
    also.check(rule)
    spark = occ.sparkSession
    left = cut(occ)
    cost, levels = (cut(df) if df is not None else None for df in (cost, levels))  # read in every round
    before = left.select("y", "x").distinct()
    n_features = features.count()
    root, turn, n, paths = shared(spark, "rounds"), 0, 0, []
    most = batch // max(1, n_features)  # cells of a batch
    batched = most > 0 and not edge_only and also == Penalties() and _only_rise(left, features, rule, cost)
    while True:
        cells = left.select("y", "x").distinct()
        candidates = edge(cells) if edge_only else cells
        if levels is not None:
            own = candidates.join(levels, ["y", "x"])
            candidates = own.join(F.broadcast(own.agg(F.min("mask_level").alias("low"))), F.col("mask_level") == F.col("low")).select("y", "x")
        if not turn or edge_only or levels is not None:
            n = candidates.count()
        if not n:
            break
        turn += 1
        k = warp if whole_blocks else max(1, min(warp, n // 100))
        found = round_deltas(left, cells, before, features, rule, n_features, seed, cost, also)
        found = found.join(candidates, ["y", "x"], "left_semi")
        path = f"{root}/{turn}"
        together = batched and k * 4 <= most
        if together:
            _cheapest(found, cells, most).write.parquet(f"{path}-cheapest")
            pool = spark.read.parquet(f"{path}-cheapest")
            removals = _batch(left, pool, features, rule, warp, whole_blocks, n, turn, cost, seed)
        else:
            removals = block(found, cells, k).withColumn("round", F.lit(turn))
        removals.select(*(F.col(c).cast("int").alias(c) for c in ("y", "x", "round", "place"))).write.parquet(path)
        chosen = spark.read.schema(REMOVALS).parquet(path)
        taken, last = chosen.agg(F.count("*"), F.max("round")).first()
        if not taken:
            raise ValueError("cells without a cost or weight are left")
        paths.append(path)
        n, turn = n - taken, last
        left = left.join(F.broadcast(chosen) if taken <= MOST_BROADCAST else chosen, ["y", "x"], "left_anti")
        if together or len(paths) % every == 0:
            left = cut(left)
    if not paths:
        return spark.createDataFrame([], REMOVALS)
    return spark.read.schema(REMOVALS).parquet(*paths)


def rank_units(occ: DataFrame, plu: DataFrame, features: DataFrame, rule: str = "caz", warp: int = 1, cost: DataFrame | None = None, every: int = 4) -> DataFrame:
    """plu_id, round, place of every planning unit with occurrences; ``plu`` has y, x, plu_id, ``cost`` is by cell.

    A round takes the unit with the least delta over its cost, whatever its size, then those of the k cheapest cells'
    units, k = max(1, min(warp, cells left // 100)), that keep the round's cells within k; ties go by plu_id.
    """
    spark = occ.sparkSession
    n_features = features.count()
    profiles = cut(unit_profiles(occ, plu))
    sizes = cut(plu.join(occ.select("y", "x").distinct(), ["y", "x"], "left_semi").groupBy("plu_id").agg(F.count("*").alias("n_cells")))
    prices = cut(unit_cost(plu, cost)) if cost is not None else None
    n, turn, removals = int(sizes.agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]), 0, []
    while n:
        turn += 1
        k = max(1, min(warp, n // 100))
        found = deltas(profiles, state(profiles, features), rule, n_features, ("plu_id",))
        if prices is not None:
            found = over_cost(found, prices, ("plu_id",))
        order = found.join(sizes, "plu_id").withColumn("delta", F.round("delta", 9)).orderBy("delta", "plu_id").limit(k)
        chosen, seen, taken = [], 0, 0
        for r in order.collect():
            if seen < k and (not chosen or r.n_cells <= k - taken):  # units too large for what is left are passed over
                chosen.append(r)
                taken += r.n_cells
            seen += r.n_cells
        if not chosen:
            raise ValueError("units without a cost are left")
        removals += [(int(r.plu_id), turn, place + 1) for place, r in enumerate(chosen)]
        n -= sum(r.n_cells for r in chosen)
        gone = spark.createDataFrame([(int(r.plu_id),) for r in chosen], "plu_id int")
        profiles = profiles.join(F.broadcast(gone), "plu_id", "left_anti")
        if turn % every == 0:
            profiles = cut(profiles)
    return spark.createDataFrame(removals, "plu_id int, round int, place int")


def _beside(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each cell the places of its eight neighbours, -1 where there is none; cells are sorted by y, x."""
    width = int(x.max() - x.min()) + 3
    at = (y - y.min() + 1).astype(np.int64) * width + (x - x.min() + 1)
    wanted = at[:, None] + np.array([dy * width + dx for dy, dx in NEAR8])
    found = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
    return np.where(at[found] == wanted, found, -1)


def _kernel(frame: pd.DataFrame, rule: str, warp: int, whole_blocks: bool, neighbours: bool, edge_only: bool, held: dict[int, float] | None = None, outside: int = 0, bound: float = np.inf) -> pd.DataFrame:
    """The same loop over one small landscape in numpy; rows are cells in the order of y, x, dense in features.

    For a batch, ``held`` is what other cells hold of each feature and nb8 a cell's present neighbours; ``outside`` other
    candidates have deltas of ``bound`` at least, and the loop ends before a round that they could enter.
    """
    units = frame.drop_duplicates(["y", "x"]).sort_values(["y", "x"]).reset_index(drop=True)
    at = pd.Series(units.index, index=pd.MultiIndex.from_frame(units[["y", "x"]]))
    names = np.sort(frame.feature.unique())
    v = np.zeros((len(units), len(names)))
    v[at.loc[list(zip(frame.y, frame.x, strict=True))].to_numpy(), np.searchsorted(names, frame.feature)] = frame.value
    by = frame.drop_duplicates("feature").set_index("feature").loc[names]
    w, p = by.weight.to_numpy(), by.sr_par.to_numpy()
    y, x, level, cost, chance = (units[c].to_numpy() for c in ("y", "x", "level", "cost", "chance"))
    beside = _beside(y, x)
    near = (beside >= 0).sum(1) if held is None else units["nb8"].to_numpy().copy()
    more = np.array([(held or {}).get(f, 0.0) for f in names.tolist()])
    ids, wv = np.arange(len(units)), v * w * p if rule == "abf" else v * w
    alive, step, out = np.ones(len(units), bool), 0, []
    while alive.any():
        if alive[ids].sum() * 10 < len(ids) * 9:  # the rows that are left move together
            v, wv, ids = v[alive[ids]], wv[alive[ids]], ids[alive[ids]]
        r = v.sum(0) + more
        with np.errstate(divide="ignore", invalid="ignore"):
            if rule == "random":
                delta = chance[ids]
            elif rule == "caz":
                share = wv / np.where(r > 0, r, np.inf)
                delta = np.where(w >= 0, share, 0.0).max(1) + np.where(w < 0, share, 0.0).min(1)
            else:
                slope = np.where(r > 0, np.where(p == 0.25, 1 / (np.sqrt(r) * np.sqrt(np.sqrt(r))), r ** (p - 1)), 0.0)
                delta = (wv * slope).sum(1)
        may = alive[ids] & (near[ids] < 8) if edge_only else alive[ids]
        can = np.flatnonzero(may & (level[ids] == level[ids[may]].min()))
        k = min(warp if whole_blocks else max(1, min(warp, (len(can) + outside) // 100)), len(can) + outside)
        if k > len(can):
            break
        found = np.round(delta[can] / cost[ids[can]], 9)
        least = np.flatnonzero(found <= np.partition(found, k - 1)[k - 1])
        rows = ids[can[least]]
        chosen = least[np.lexsort((rows, near[rows] if neighbours else np.zeros(len(rows)), found[least]))][:k]
        if outside and step and found[chosen].max() >= bound * (1 - 1e-12) - 1e-9:  # engines round differently
            break
        gone = ids[can[chosen]]
        step += 1
        out += [(i, step, place + 1) for place, i in enumerate(gone.tolist())]
        alive[gone], v[can[chosen]], wv[can[chosen]] = False, 0.0, 0.0
        touched = beside[gone]
        np.subtract.at(near, touched[touched >= 0], 1)
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    return pd.DataFrame({"y": y[found[:, 0]], "x": x[found[:, 0]], "round": found[:, 1], "place": found[:, 2]})


def _rows(occ: DataFrame, features: DataFrame, rule: str, levels: DataFrame | None, cost: DataFrame | None, seed: int) -> DataFrame:
    """What ``_kernel`` reads: occurrences with their features' and cells' numbers."""
    rows = occ.join(F.broadcast(features.select("feature", "weight", "sr_par")), "feature")
    rows = rows.join(levels, ["y", "x"]).withColumnRenamed("mask_level", "level") if levels is not None else rows.withColumn("level", F.lit(0))
    rows = rows.join(cost.select("y", "x", "cost"), ["y", "x"]) if cost is not None else rows.withColumn("cost", F.lit(1.0))
    rows = rows.join(random_deltas(occ, seed).withColumnRenamed("delta", "chance"), ["y", "x"]) if rule == "random" else rows.withColumn("chance", F.lit(0.0))
    return rows.withColumn("whole", F.lit(1))


def rank_small(occ: DataFrame, features: DataFrame, rule: str = "caz", warp: int = 1, levels: DataFrame | None = None, cost: DataFrame | None = None, seed: int = 0, whole_blocks: bool = True, neighbours: bool = False, edge_only: bool = False) -> DataFrame:
    """As ``rank`` for the rules caz, abf and random, in one task: for landscapes of up to some ten million cells
    times features.  Ties go by (delta, y, x), with ``neighbours`` by (delta, present neighbours, y, x); with
    ``edge_only`` only cells next to a missing one can go."""
    if rule not in ("caz", "abf", "random"):
        raise ValueError(f"no kernel for the rule {rule}")
    rows = _rows(occ, features, rule, levels, cost, seed)
    return rows.groupBy("whole").applyInPandas(lambda frame: _kernel(frame, rule, warp, whole_blocks, neighbours, edge_only), "y int, x int, round int, place int")


def replay(occ: DataFrame, order: DataFrame) -> DataFrame:
    """step, feature, repr: what is left of each feature after each removal that touches it, in a given order.

    ``order`` has y, x, step; cells without a step are never removed.  No loop: sums run over the steps.
    """
    sums = occ.groupBy("feature").agg(F.sum("value").alias("total"))
    steps = occ.join(order.select("y", "x", "step"), ["y", "x"]).groupBy("feature", "step").agg(F.sum("value").alias("value"))
    lost = running_sum(steps, ["feature"], "step", "value", "lost")
    return lost.join(F.broadcast(sums), "feature").select("step", "feature", (1 - F.col("lost") / F.col("total")).alias("repr"))


def consistent(occ: DataFrame, order: DataFrame) -> DataFrame:
    """Cells that only one of a landscape and a ranking has, and which."""
    cells = occ.select("y", "x").distinct()
    lacking = cells.join(order, ["y", "x"], "left_anti").select("y", "x", F.lit("ranking").alias("missing_in"))
    return lacking.union(order.join(cells, ["y", "x"], "left_anti").select("y", "x", F.lit("landscape").alias("missing_in")))
