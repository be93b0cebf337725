"""Corridor-loss penalties: what removing a cell does to the connected area it is part of."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import NEAR4
from .graph import component_stats, patches
from .rules import split_risk


def fast_penalty(cells: DataFrame, occ: DataFrame, xd: int, strength: float, by_area: bool = False) -> DataFrame:
    """For cells that may split their component: strength (radius / distance)^2 (component / all that remains).

    The radius is the component's spread, the distance that of the cell from its centre; at the centre the
    distance counts as one cell.
    """
    labels = patches(cells, xd, diagonal=False)
    stats = component_stats(labels, occ).join(labels.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), "label")
    whole = stats.agg(F.sum("area").alias("all_area"), F.sum("richness").alias("all_richness"))
    rows = split_risk(cells).join(labels, ["y", "x"]).join(stats, "label").crossJoin(F.broadcast(whole))
    distance = F.greatest((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2, F.lit(1.0))
    part = F.col("area") / F.col("all_area") if by_area else F.col("richness") / F.col("all_richness")
    return rows.select("y", "x", "label", (F.lit(strength) * (F.col("var_x") + F.col("var_y")) / distance * part).alias("penalty"))


#: The eight neighbours in a ring; every second one, from the first, shares a side with the cell.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def may_split(present: np.ndarray, y: int, x: int) -> bool:
    """Whether the side neighbours of a cell aren't already joined around it within the ring."""
    there = [bool(present[y + dy, x + dx]) for dy, dx in RING]
    if all(there):
        return False
    start = there.index(False)
    arcs, joined = 0, False
    for i in range(start, start + 9):
        if not there[i % 8]:
            arcs += joined
            joined = False
        elif i % 2 == 0:
            joined = True
    return arcs > 1


def split_parts(present: np.ndarray, y: int, x: int, amount: np.ndarray) -> list[tuple[int, float]]:
    """Area and amount of each part that the neighbours of a cell fall into once it is gone."""
    seen, parts = {(y, x)}, []
    for dy, dx in NEAR4:
        start = (y + dy, x + dx)
        if start in seen or not present[start]:
            continue
        queue, area, total = deque([start]), 0, 0.0
        seen.add(start)
        while queue:
            a, b = queue.popleft()
            area += 1
            total += amount[a, b]
            for ey, ex in NEAR4:
                n = (a + ey, b + ex)
                if n not in seen and present[n]:
                    seen.add(n)
                    queue.append(n)
        parts.append((area, total))
    return parts


def joined_nearby(present: np.ndarray, start: tuple[int, int], goal: tuple[int, int], reach: int) -> bool:
    """Whether a path over side neighbours joins two cells within ``reach`` rows and columns of the first."""
    (y, x), seen, queue = start, {start}, deque([start])
    while queue:
        a, b = queue.popleft()
        if (a, b) == goal:
            return True
        for dy, dx in NEAR4:
            n = (a + dy, b + dx)
            if n not in seen and abs(n[0] - y) <= reach and abs(n[1] - x) <= reach and 0 <= n[0] < present.shape[0] and 0 <= n[1] < present.shape[1] and present[n]:
                seen.add(n)
                queue.append(n)
    return False


def cut_cells(y: np.ndarray, x: np.ndarray, amount: np.ndarray) -> dict[int, list[float]]:
    """For a connected set of cells: the place of each one whose removal splits it, and the amounts of the parts.

    One walk in depth over the cells: a branch that reaches nothing above a cell comes apart when the cell goes.
    """
    width = int(x.max() - x.min()) + 3
    at = (y - y.min() + 1).astype(np.int64) * width + (x - x.min() + 1)
    order = np.argsort(at)
    wanted = at[:, None] + np.array([dy * width + dx for dy, dx in NEAR4])
    found = np.minimum(np.searchsorted(at, wanted, sorter=order), len(at) - 1)
    beside = np.where(at[order[found]] == wanted, order[found], -1).tolist()
    seen, low, below, parts = [-1] * len(y), [0] * len(y), amount.astype(float).tolist(), {}
    seen[0], count, walk = 0, 1, [(0, -1, 0)]
    while walk:
        v, parent, k = walk.pop()
        if k < 4:
            walk.append((v, parent, k + 1))
            n = beside[v][k]
            if n < 0 or n == parent:
                continue
            if seen[n] >= 0:
                low[v] = min(low[v], seen[n])
            else:
                seen[n] = low[n] = count
                count += 1
                walk.append((n, v, 0))
        elif parent >= 0:
            low[parent] = min(low[parent], low[v])
            below[parent] += below[v]
            if low[v] >= seen[parent]:
                parts.setdefault(parent, []).append(below[v])
    whole = float(amount.sum())
    for v, held in parts.items():
        if v:
            held.append(whole - float(amount[v]) - sum(held))
    return {v: held for v, held in parts.items() if len(held) > 1}


#: formula -> (parts' amounts, the component's amount, all that remains, labels) -> share
FORMULAS = {
    1: lambda p, own, rest: sorted(p)[-2] / rest,
    2: lambda p, own, rest: (len(p) - 1) * own / rest,
    3: lambda p, own, rest: min(p) / own,
    4: lambda p, own, rest: min(p) / rest,
}


def exact_penalty(cells: DataFrame, occ: DataFrame, yd: int, xd: int, strength: float, formula: int = 1) -> DataFrame:
    """The penalty from the parts that really come apart; formulas 1-4 by richness, 11-14 by area.

    Components are found in parallel; each component's cells are then one group, walked once, so a component must fit a task.
    """
    by_area = formula > 10
    labels = patches(cells, xd, diagonal=False)
    rich = occ.groupBy("y", "x").agg(F.sum("value").alias("richness"))
    rows = labels.join(rich, ["y", "x"])
    rest = rows.agg(F.sum("richness").alias("rest"), F.count("*").cast("double").alias("n"))
    rows = rows.crossJoin(F.broadcast(rest))
    share = FORMULAS[formula % 10]

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame.y.to_numpy(), frame.x.to_numpy()
        amount = np.ones(len(y)) if by_area else frame.richness.to_numpy()
        own, whole = float(amount.sum()), float(frame["n" if by_area else "rest"].iloc[0])
        out = [(y[v], x[v], strength * share(parts, own - amount[v], whole)) for v, parts in cut_cells(y, x, amount).items()]
        return pd.DataFrame(out, columns=["y", "x", "penalty"])

    return rows.groupBy("label").applyInPandas(task, "y int, x int, penalty double")


def penalised(cells: DataFrame, penalties: DataFrame, rank: DataFrame, top: float) -> DataFrame:
    """The penalised cells within the best ``top`` of the ranking."""
    return penalties.join(rank.where(F.col("rank") >= 1 - top), ["y", "x"], "left_semi").join(cells, ["y", "x"], "left_semi")
