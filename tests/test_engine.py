import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialrank.functions import benefit
from spatialrank.lineage import numbered, running_sum
from spatialrank.operators import corridors, curves, focal, graph, greedy, regions, rules
from spatialrank.operators import transforms as t


def occ_of(spark, rows):
    return spark.createDataFrame([(int(a), int(b), int(f), float(v)) for a, b, f, v in rows], "y int, x int, feature int, value double")


def features_of(spark, n, weights=None):
    return spark.createDataFrame([(i, f"f{i}", float((weights or [1] * n)[i]), 0.25, 1.0, 0.3, 0.5, 0.25, i % 2) for i in range(n)], "feature int, name string, weight double, sr_par double, w2 double, tj double, exp1 double, exp2 double, grp int")


def random_occ(spark, seed=0, size=7, features=3, fill=0.6):
    random = np.random.default_rng(seed)
    return occ_of(spark, [(y, x, f, random.integers(1, 20)) for y in range(1, size) for x in range(1, size) for f in range(features) if random.random() < fill])


#: One cell and two features worked by hand: R = (.8, .5), loss (.1, .02), weights (1, 2), cost 2.
@pytest.mark.parametrize("rule, want", [("caz", 0.0625), ("abf", 0.0231861768), ("tbf", 1.0160881475), ("gbf", 0.0344435519)])
def test_rules_by_hand(spark, rule, want):
    units = occ_of(spark, [(1, 1, 0, 0.1), (1, 1, 1, 0.02)])
    second = 0.49 if rule == "tbf" else 0.3
    now = spark.createDataFrame([(0, 1.0, 0.25, 1.0, 0.3, 0.5, 0.25, 0.8), (1, 2.0, 0.25, 1.0, second, 0.5, 0.25, 0.5)], "feature int, weight double, sr_par double, w2 double, tj double, exp1 double, exp2 double, r double")
    cost = spark.createDataFrame([(1, 1, 2.0)], "y int, x int, cost double")
    assert rules.over_cost(rules.deltas(units, now, rule, 2), cost).first().delta == pytest.approx(want, abs=1e-9)


def test_negative_weight_gives_relief(spark):
    units = occ_of(spark, [(1, 1, 0, 0.1), (1, 1, 1, 0.2), (2, 2, 1, 0.2)])
    now = spark.createDataFrame([(0, 1.0, 1.0), (1, -1.0, 0.5)], "feature int, weight double, r double")
    assert {(r.y, round(r.delta, 9)) for r in rules.deltas(units, now, "caz", 2).collect()} == {(1, -0.3), (2, -0.4)}


def test_boundary_term_by_hand(spark):
    cells = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (9, 9)], "y int, x int")
    got = {(r.y, r.x): (r.nb4, r.term) for r in rules.boundary_term(cells, 0.5).collect()}
    bl, n = 14, 5
    assert got[1, 2] == (3, pytest.approx(0.5 * (bl / n - (bl + 2) / (n - 1))))
    assert got[9, 9] == (0, pytest.approx(0.5 * (bl / n - (bl - 4) / (n - 1))))


def test_random_deltas(spark):
    occ = random_occ(spark, size=25, features=1, fill=1)
    a, b, c = ([r.delta for r in rules.random_deltas(occ, s).orderBy("y", "x").collect()] for s in (1, 1, 2))
    assert a == b != c and 0 <= min(a) and max(a) < 1 and 0.4 < np.mean(a) < 0.6


def plain_greedy(rows, weights, rule, k, ties):
    left = {}
    for y, x, f, v in rows:
        left.setdefault((y, x), {})[f] = v
    out, turn = {}, 0
    while left:
        turn += 1
        r = {}
        for vs in left.values():
            for f, v in vs.items():
                r[f] = r.get(f, 0) + v
        near = lambda c: sum((c[0] + dy, c[1] + dx) in left for dy, dx in focal.NEAR8)  # noqa: B023, E731
        delta = {c: round(max(weights[f] * v / r[f] for f, v in vs.items()) if rule == "caz" else sum(v * weights[f] * 0.25 * r[f] ** -0.75 for f, v in vs.items()), 9) for c, vs in left.items()}
        for c in sorted(left, key=lambda c: (delta[c], near(c) if ties else 0, *c))[:k]:
            out[c] = turn
        left = {c: vs for c, vs in left.items() if c not in out}
    return out


@pytest.mark.parametrize("rule", ["caz", "abf"])
def test_loop_and_kernel_like_plain_code(spark, rule):
    occ = random_occ(spark, 3)
    rows, weights = [tuple(r) for r in occ.collect()], [1, 2, 3]
    features = features_of(spark, 3, weights)
    small = {(r.y, r.x): r.round for r in greedy.rank_small(occ, features, rule, 2).collect()}
    assert small == plain_greedy(rows, weights, rule, 2, False)
    loop = {(r.y, r.x): r.round for r in greedy.rank(occ, features, rule, warp=9, whole_blocks=True, every=2).collect()}
    assert loop == plain_greedy(rows, weights, rule, 9, True)


def test_levels_and_edges(spark):
    occ = random_occ(spark, 5, size=5)
    levels = occ.select("y", "x").distinct().withColumn("mask_level", F.col("x") % 2)
    got = greedy.rank(occ, features_of(spark, 3), warp=4, whole_blocks=True, levels=levels, edge_only=True).collect()
    assert len(got) == levels.count()
    assert max(r.round for r in got if r.x % 2 == 0) < min(r.round for r in got if r.x % 2 == 1)


def test_replay_repeats_a_ranking(spark):
    occ = random_occ(spark, 4, size=5)
    order = spark.createDataFrame([(r.y, r.x, r.round) for r in greedy.rank_small(occ, features_of(spark, 3)).collect()], "y int, x int, step long")
    got = greedy.replay(occ, order).collect()
    for f in range(3):
        steps = [r.repr for r in sorted((r for r in got if r.feature == f), key=lambda r: r.step)]
        assert steps == sorted(steps, reverse=True) and steps[-1] == pytest.approx(0, abs=1e-12)
    at = curves.at_steps(order.where("step % 5 = 0").select("step"), occ, order).collect()
    by = {(r.feature, r.step): r.repr for r in got}
    for r in at:
        last = max((s for f, s in by if f == r.feature and s <= r.step), default=None)
        assert r.repr == pytest.approx(by[r.feature, last] if last else 1)


def test_fft_is_the_join(spark):
    occ = random_occ(spark, 1, size=10)
    weights = focal.kernel("exponential", 0.5, 12)
    joined = {(r.y, r.x, r.feature): r.value for r in focal.at_present(focal.convolve(occ, weights), occ).collect()}
    fft = {(r.y, r.x, r.feature): r.conn for r in focal.convolve_fft(occ, 12, 12, lambda d: np.exp(-0.5 * d) / (2 * np.pi * 0.25)).collect()}
    assert joined.keys() == fft.keys() and all(joined[k] == pytest.approx(fft[k], rel=1e-5) for k in joined)


def test_tabulated_kernel(spark):
    with pytest.raises(ValueError):
        benefit.tabulated([(0, 1), (0, 2)])
    f = benefit.tabulated([(0.0, 1.0), (2.0, 0.5), (4.0, -1.0)])
    row = spark.range(1).select(*(f(F.lit(d), 0).alias(f"c{i}") for i, d in enumerate((0.0, 1.0, 3.0, 9.0)))).first()
    assert list(row) == [1.0, 0.75, 0.0, 0.0]


def test_omissions_like_the_running_rule(spark):
    occ = random_occ(spark, 6, size=9, features=4)
    rows = sorted(tuple(r)[:3] for r in occ.collect() if r.feature < 3)
    zeroed, want = 0, set()
    for i, key in enumerate(rows):
        if 0.3 >= (zeroed / i if i else 0.0) - 1e-12:
            zeroed += 1
            want.add(key)
    got = t.omitted(occ, 30.0, 3)
    assert {(r.y, r.x, r.feature) for r in got.where("value = 0").collect()} == want
    assert all(abs(a.total - b.total) < 1e-9 for a, b in zip(t.totals(got).orderBy("feature").collect(), t.totals(occ).orderBy("feature").collect()))


def test_missing_condition_leaves_the_value(spark):
    occ = occ_of(spark, [(1, 1, 0, 4), (1, 2, 0, 4), (1, 1, 1, 4)])
    ret = spark.createDataFrame([(1, 1, 0.25), (1, 2, None)], "y int, x int, ret double")
    assert {tuple(r) for r in t.retained(occ, features_of(spark, 2), 0, ret).collect()} == {(1, 1, 0, 3.0), (1, 2, 0, 4.0), (1, 1, 1, 4.0)}


def test_tree(spark):
    tree = lambda rows: spark.createDataFrame(rows, "id int, down_id int")
    got = {r.id: r.root for r in regions.basins(tree([(0, -1), (1, 0), (2, 1), (3, 2), (4, 4), (5, 99), (6, 5)])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}
    with pytest.raises(ValueError, match="cycle"):
        regions.closure(tree([(0, 1), (1, 2), (2, 0)])).collect()


def test_patches_over_tiles(spark):
    random = np.random.default_rng(6)
    cells = spark.createDataFrame([(int(y), int(x)) for y, x in np.argwhere(random.random((40, 50)) < 0.45)], "y int, x int")
    present = {tuple(r) for r in cells.collect()}
    for diagonal in (True, False):
        near = focal.NEAR8 if diagonal else focal.NEAR4
        want, left = {}, set(present)
        for cell in sorted(present):
            if cell in left:
                found, label = [cell], cell[0] * 50 + cell[1]
                left.discard(cell)
                while found:
                    y, x = found.pop()
                    want[y, x] = label
                    for n in ((y + dy, x + dx) for dy, dx in near):
                        if n in left:
                            left.discard(n)
                            found.append(n)
        for tile in (7, 512):
            assert {(r.y, r.x): r.label for r in graph.patches(cells, 50, diagonal, tile).collect()} == want


def test_patches_and_erosion(spark):
    block = [(y, x) for y in range(1, 6) for x in range(1, 6)]
    cells = spark.createDataFrame(block + [(6, 6), (9, 9), (9, 10)], "y int, x int")
    eight = {(r.y, r.x): r.label for r in graph.patches(cells, 20).collect()}
    four = {(r.y, r.x): r.label for r in graph.patches(cells, 20, diagonal=False).collect()}
    assert eight[6, 6] == eight[1, 1] == 21 and four[6, 6] == 126 and four[9, 9] == four[9, 10] != four[1, 1]
    assert {tuple(r) for r in focal.eroded(cells, 1).collect()} == {(y, x) for y in range(2, 5) for x in range(2, 5)} | {(5, 5)} - {(5, 5)}
    assert {tuple(r) for r in graph.near_patches(graph.patches(cells, 20), 5).collect()} == {(21, 189)}
    assert graph.near_patches(graph.patches(cells, 20), 0).count() == 0


def test_corridors_by_hand(spark):
    # two blocks of four joined by one cell
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (1, 4), (1, 5)]
    cells = spark.createDataFrame(rows, "y int, x int")
    occ = occ_of(spark, [(y, x, 0, 2) for y, x in rows])
    exact = {(r.y, r.x): r.penalty for r in corridors.exact_penalty(cells, occ, 5, 8, 3.0).collect()}
    assert exact == {(2, 3): pytest.approx(3.0 * 8 / 18), (2, 2): pytest.approx(3.0 * 6 / 18), (2, 4): pytest.approx(3.0 * 6 / 18)}
    least = {(r.y, r.x): r.penalty for r in corridors.exact_penalty(cells, occ, 5, 8, 3.0, 13).collect()}
    assert least[2, 3] == pytest.approx(3.0 * 4 / 8) and least[2, 2] == pytest.approx(3.0 * 3 / 8)
    fast = {(r.y, r.x): r.penalty for r in corridors.fast_penalty(cells, occ, 8, 3.0, by_area=True).collect()}
    assert (2, 3) in fast and all(v > 0 for v in fast.values())


def test_only_cells_that_may_split_do():
    random = np.random.default_rng(9)
    split = 0
    for _ in range(300):
        present = np.zeros((9, 9), bool)
        present[1:8, 1:8] = random.random((7, 7)) < 0.7
        present[4, 4] = False
        parts = corridors.split_parts(present, 4, 4, present.astype(float))
        if len(parts) > 1:
            split += 1
            assert corridors.may_split(present, 4, 4)
    assert split > 20


def test_numbers_and_running_sums(spark):
    random = np.random.default_rng(2)
    rows = [(int(k), int(s), float(v)) for s, (k, v) in enumerate(zip(random.integers(0, 3, 300), random.integers(0, 9, 300)))]
    df = spark.createDataFrame(rows, "k int, s long, v double")
    got = {(r.k, r.s): r.t for r in running_sum(df, ["k"], "s", "v", "t", block=16).collect()}
    sums = {}
    for k, s, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[k, s] == sums[k]
    steps = numbered(df, [F.desc("v"), F.col("s")]).collect()
    assert [r.s for r in sorted(steps, key=lambda r: r.step)] == [s for _, s, _ in sorted(rows, key=lambda r: (-r[2], r[1]))]
    assert sorted(r.step for r in steps) == list(range(1, 301))


def test_results_do_not_depend_on_partitions(spark):
    occ, features = random_occ(spark, 8), features_of(spark, 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, greedy.block(rules.deltas(occ, rules.state(occ, features), "caz", 3), t_cells(occ), 5).collect())))
        assert found[0] == found[1] == found[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def t_cells(occ):
    return occ.select("y", "x").distinct()


def test_cut_cells_like_flood_fill():
    random = np.random.default_rng(8)
    for _ in range(30):
        grid = np.zeros((9, 10), bool)
        grid[1:-1, 1:-1] = random.random((7, 8)) < 0.7
        amount = random.random((9, 10))
        left = set(map(tuple, np.argwhere(grid)))
        while left:
            patch, queue = [], [left.pop()]
            while queue:
                c = queue.pop()
                patch.append(c)
                for n in ((c[0] + dy, c[1] + dx) for dy, dx in focal.NEAR4):
                    if n in left:
                        left.discard(n)
                        queue.append(n)
            y, x = np.array(patch).T
            got = corridors.cut_cells(y, x, amount[y, x])
            own = np.zeros_like(grid)
            own[y, x] = True
            for i, (a, b) in enumerate(patch):
                own[a, b] = False
                parts = sorted(total for _, total in corridors.split_parts(own, a, b, amount))
                own[a, b] = True
                assert np.allclose(sorted(got.get(i, parts)), parts) and (i in got) == (len(parts) > 1)


def test_paths_within_reach():
    present = np.zeros((9, 9), bool)
    present[1, 1:8] = present[1:8, 7] = present[7, 1:8] = True
    present[3, 1] = True
    assert corridors.joined_nearby(present, (1, 1), (7, 1), 6) and not corridors.joined_nearby(present, (1, 1), (7, 1), 5)
    assert not corridors.joined_nearby(present, (1, 1), (3, 1), 8) and corridors.joined_nearby(present, (1, 3), (1, 5), 2)


def test_resampled_features(spark):
    features = spark.range(40).select(F.col("id").cast("int").alias("feature"))
    drawn = [sorted(r.feature for r in t.subsampled(features, 10, seed).collect()) for seed in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and all(len(set(d)) == 10 for d in drawn)
    assert t.subsampled(features, 99, 1).count() == 40
