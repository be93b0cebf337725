"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from spatialrank.plans import losses  # registers its queries
from spatialrank.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "part", "orders", "lineitem", "events")
CHOSEN = ["occ_normalised", "infogap_prop", "retention_weights", "deterministic_omissions", "box_count_r2", "convolve_exp_r3", "interaction_negative", "delta_caz_negw", "delta_gbf", "bqp_buffer", "two_round_unrolled_full", "greedy_abf_window", "greedy_masked_window", "rank_map", "replay_curves", "group_curves", "tree_amounts", "admu_area_rank", "networks", "top_fraction_boundary", "cells_for_90pct", "cost_for_fraction", "plu_alignment"]
CHOSEN += [n for n in vars(losses) if n in SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return (0, 0) if v is None else (1, float(v)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else (2, str(v))


@pytest.mark.parametrize("name", CHOSEN)
def test_like_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want and want


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == {"convolve_fft", "delta_random", "greedy_distributed", "greedy_random_seeded", "corridor_penalty_fast", "corridor_penalty_exact", "resampled_features"}
