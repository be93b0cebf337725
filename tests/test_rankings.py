"""Rankings of the whole landscape."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spatialrank.operators import greedy
from spatialrank.plans import rankings
from spatialrank.plans.fixtures import Fixture
from spatialrank.plans.queries import QUERIES

from .test_engine import features_of, plain_greedy, random_occ

SF = "/root/testdata/sf0.001"


def test_no_query_ranks_a_corner():
    offered = __spark_entry__.queries()
    assert not set(rankings.WINDOWED) & (set(offered) | set(__spark_entry__.oracle_sql()))
    assert set(rankings.QUERIES) == {"greedy_caz_cells", "greedy_abf_cells", "greedy_masked_cells", "greedy_caz_tens", "greedy_plu_units"} <= set(offered)


@pytest.mark.parametrize("name, rule, k, side", [("greedy_caz_cells", "caz", 1, 1), ("greedy_abf_cells", "abf", 1, 1), ("greedy_caz_tens", "caz", 10, 1), ("greedy_plu_units", "caz", 1, 4)])
def test_every_unit_is_ranked_like_plain_code(spark, name, rule, k, side):
    f = Fixture(spark, SF)
    sums = {}
    for r in f.occ.collect():
        key = r.y // side, r.x // side, r.feature
        sums[key] = sums.get(key, 0) + r.value
    weights = {r.feature: r.weight for r in f.features.collect()}
    got = {(r.y, r.x): r["round"] for r in rankings.QUERIES[name](spark, SF).collect()}
    assert got == plain_greedy([(*key, v) for key, v in sums.items()], weights, rule, k, False)


def test_masked_ranking_goes_level_by_level(spark):
    got = rankings.QUERIES["greedy_masked_cells"](spark, SF).collect()
    levels = [(r.x + r.y) // 9 for r in sorted(got, key=lambda r: r["round"])]
    assert levels == sorted(levels) and len(got) == Fixture(spark, SF).present.count()


def test_blocks_hold_a_hundredth_of_what_is_left(spark):
    got = QUERIES["greedy_random_seeded"](spark, SF).collect()
    sizes = [n for _, n in sorted(Counter(r["round"] for r in got).items())]
    left = Fixture(spark, SF).present.count()
    assert sum(sizes) == left
    for n in sizes:
        assert n == max(1, left // 100)
        left -= n


@pytest.mark.parametrize("rule", ["caz", "abf", "random"])
def test_loop_is_the_kernel(spark, rule):
    occ = random_occ(spark, 7, size=6)
    features = features_of(spark, 3, [1, 2, -1] if rule == "caz" else [1, 2, 3])
    cost = occ.select("y", "x").distinct().withColumn("cost", 1.0 + F.col("x") % 3)
    loop = greedy.rank(occ, features, rule, warp=9, cost=cost, seed=3).collect()
    small = greedy.rank_small(occ, features, rule, 9, cost=cost, seed=3, whole_blocks=False, neighbours=True).collect()
    assert sorted(map(tuple, loop)) == sorted(map(tuple, small))


def test_flagship_follows_the_blocks(spark):
    f = Fixture(spark, SF)
    got = __spark_entry__.entry(spark)
    assert got.agg(F.max("step")).first()[0] == f.present.count()
    lost = got.groupBy("feature").agg(F.min("repr").alias("least")).collect()
    assert all(abs(r.least) < 1e-9 for r in lost) and len(lost) == 8


@pytest.mark.parametrize("rule", ["caz", "abf", "random"])
def test_batches_are_single_rounds(spark, rule, monkeypatch):
    occ = random_occ(spark, 21, size=9)
    features = features_of(spark, 3, [1, 2, 3])
    levels = occ.select("y", "x").distinct().withColumn("mask_level", (F.col("x") > 4).cast("int"))
    cost = levels.select("y", "x", (1.0 + F.col("x") % 3).alias("cost"))
    sizes, batch = [], greedy._batch
    monkeypatch.setattr(greedy, "_batch", lambda *a: sizes.append(a[1].count()) or batch(*a))
    single = lambda levels: sorted(map(tuple, greedy.rank_small(occ, features, rule, 4, levels, cost, 3, neighbours=True).collect()))
    ranked = lambda levels: sorted(map(tuple, greedy.rank(occ, features, rule, 4, cost, levels, seed=3, whole_blocks=True, batch=66).collect()))
    # 22 cells at a time leave others out: a batch ends before a round that they could enter
    assert ranked(None) == single(None)
    assert sizes[0] == 22 and 1 < len(sizes) < levels.count() / 4
    if rule == "caz":
        assert ranked(levels) == single(levels) != single(None)


def test_batches_leave_out_rules_that_may_fall(spark, monkeypatch):
    monkeypatch.setattr(greedy, "_batch", lambda *a: pytest.fail("a batch"))
    occ = random_occ(spark, 7, size=3)
    for weights, rule in ([1, 2, -1], "caz"), ([1, 2, 3], "gbf"):
        assert greedy.rank(occ, features_of(spark, 3, weights), rule, warp=9, whole_blocks=True).count() == occ.select("y", "x").distinct().count()


def test_the_loop_takes_few_jobs(spark, monkeypatch):
    # one removal in a round, hundreds of rounds
    calls, deltas = [], greedy.round_deltas
    monkeypatch.setattr(greedy, "round_deltas", lambda *a: calls.append(1) or deltas(*a))
    got = QUERIES["greedy_distributed"](spark, SF)
    assert got.agg(F.max("round")).first()[0] > 100 and len(calls) == 1
    f = Fixture(spark, SF)
    n = f.present.count()
    small = greedy.rank_small(f.occ, f.features, "caz", -(-n // 4), cost=f.cost, whole_blocks=False, neighbours=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, small.collect()))
