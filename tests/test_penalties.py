"""Penalties, administrative weights and planning units in the rounds of a ranking, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialrank.operators import corridors, focal, greedy

from .test_engine import features_of, occ_of, random_occ

WEIGHTS = [1, 2, 3]
PROFILE = [(1.0, 1.0), (0.5, 0.8), (0.0, 0.2)]
RING = [o for o in focal.box(1) if o != (0, 0)]


def near(cells, c, offsets):
    return sum((c[0] + dy, c[1] + dx) in cells for dy, dx in offsets)


def ranked(rows, delta, k):
    """Rounds of k cells by (delta, neighbours, y, x); ``delta`` gets what is left and all cells."""
    left = {}
    for y, x, f, v in rows:
        left.setdefault((y, x), {})[f] = v
    before, out, turn = set(left), {}, 0
    while left:
        turn += 1
        found = delta(left, before)
        for c in sorted(left, key=lambda c: (round(found[c], 9), near(left, c, focal.NEAR8), *c))[:k]:
            out[c] = turn
        left = {c: vs for c, vs in left.items() if c not in out}
    return out


def sums(left):
    return [sum(vs.get(f, 0) for vs in left.values()) for f in range(3)]


def core(left):
    r = sums(left)
    return {c: max(WEIGHTS[f] * v / r[f] for f, v in vs.items()) for c, vs in left.items()}


def less_boundary(left, before):
    bl, n, found = sum(4 - near(left, c, focal.NEAR4) for c in left), len(left), core(left)
    return {c: found[c] - (0 if n < 2 or near(left, c, focal.NEAR4) == 2 else 0.5 * (bl / n - (bl + 2 * near(left, c, focal.NEAR4) - 4) / (n - 1))) for c in left}


def of_quality(left, before):
    g = lambda s: float(np.interp(s, [0, 0.5, 1], [0.2, 0.8, 1.0]))
    o, k = ({c: near(s, c, RING) for c in left} for s in (before, left))
    kept = {c: {f: v * (g(k[c] / o[c]) if o[c] else 1.0) for f, v in vs.items()} for c, vs in left.items()}
    r, found = sums(kept), {}
    for c in left:
        lost = dict(kept[c])
        for dy, dx in RING:
            q = (c[0] + dy, c[1] + dx)
            if q in left:
                for f, v in left[q].items():
                    lost[f] = lost.get(f, 0) + v * (g(k[q] / o[q]) - g((k[q] - 1) / o[q]))
        found[c] = max(WEIGHTS[f] * v / r[f] for f, v in lost.items())
    return found


def own(f, a):
    return 1.0 + (f + a) % 3


def regional(mode):
    def delta(left, before):
        r, found = sums(left), {}
        for c, vs in left.items():
            a = c[1] % 2
            if mode == 1:
                found[c] = max(0.5 * (0.5 * own(f, a) + 0.5 * WEIGHTS[f]) * v / r[f] for f, v in vs.items())
            else:
                ra = sums({q: w for q, w in left.items() if q[1] % 2 == a})
                found[c] = 0.5 * max(WEIGHTS[f] * v / r[f] for f, v in vs.items()) + 0.5 * max(0.5 * own(f, a) * v / ra[f] for f, v in vs.items()) / 2
        return found

    return delta


def regions_of(spark, occ, mode):
    cells = occ.select("y", "x").distinct().withColumn("admu", F.col("x") % 2)
    weights = spark.createDataFrame([(f, a, own(f, a)) for f in range(3) for a in range(2)], "feature int, admu int, w double")
    units = spark.createDataFrame([(a, 0.5, 0.5) for a in range(2)], "admu int, global_w double, local_w double")
    return cells, weights, units, mode


@pytest.mark.parametrize("kind", ["boundary", "quality", "mode1", "mode2"])
def test_every_round_has_the_term(spark, kind):
    occ = random_occ(spark, 12, size=6)
    rows, features = [tuple(r) for r in occ.collect()], features_of(spark, 3, WEIGHTS)
    also, delta = {
        "boundary": lambda: (greedy.Penalties(blp=0.5), less_boundary),
        "quality": lambda: (greedy.Penalties(quality=(1, PROFILE)), of_quality),
        "mode1": lambda: (greedy.Penalties(regions=regions_of(spark, occ, 1)), regional(1)),
        "mode2": lambda: (greedy.Penalties(regions=regions_of(spark, occ, 2)), regional(2)),
    }[kind]()
    got = {(r.y, r.x): r["round"] for r in greedy.rank(occ, features, warp=6, whole_blocks=True, every=2, also=also).collect()}
    want = ranked(rows, delta, 6)
    assert got == want != ranked(rows, lambda left, before: core(left), 6)


def test_corridor_cells_stay(spark):
    # two blocks of four joined by one cell, which is the cheapest
    cells = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (1, 4), (1, 5)]
    occ = occ_of(spark, [(y, x, 0, 1 if (y, x) == (2, 3) else 2 + y + x) for y, x in cells])
    first = lambda **also: greedy.rank(occ, features_of(spark, 1), warp=3, whole_blocks=True, also=greedy.Penalties(**also)).where("round = 1")
    assert (2, 3) in {(r.y, r.x) for r in first().collect()}
    assert (2, 3) in {(r.y, r.x) for r in corridors.fast_penalty(occ.select("y", "x"), occ, 8, 50.0).collect()}
    assert (2, 3) not in {(r.y, r.x) for r in first(corridor=(8, 50.0)).collect()}


@pytest.mark.parametrize("warp", [1, 3])
def test_units(spark, warp):
    occ = random_occ(spark, 13, size=20)
    plu = occ.select("y", "x").distinct().withColumn("plu_id", (F.floor(F.col("y") / 7) * 5 + F.floor(F.col("x") / 4)).cast("int"))
    cost = plu.select("y", "x", (1.0 + F.col("x") % 3).alias("cost"))
    unit = {(r.y, r.x): r.plu_id for r in plu.collect()}
    left, size, price = {}, {}, {}
    for y, x, f, v in map(tuple, occ.collect()):
        vs = left.setdefault(unit[y, x], {})
        vs[f] = vs.get(f, 0) + v
    for (y, x), u in unit.items():
        size[u], price[u] = size.get(u, 0) + 1, price.get(u, 0) + 1 + x % 3
    want, turn = {}, 0
    while left:
        turn += 1
        k, delta, taken, seen = max(1, min(warp, sum(size[u] for u in left) // 100)), core(left), 0, 0
        for u in sorted(left, key=lambda u: (round(delta[u] / price[u], 9), u)):
            if seen < k and (not taken or size[u] <= k - taken):
                want[u], taken = turn, taken + size[u]
            seen += size[u]
        left = {u: vs for u, vs in left.items() if u not in want}
    got = {r.plu_id: r["round"] for r in greedy.rank_units(occ, plu, features_of(spark, 3, WEIGHTS), warp=warp, cost=cost).collect()}
    assert got == want
