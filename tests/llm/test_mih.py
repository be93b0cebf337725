import numpy as np
import pytest

from spatialrank.llm import mih, queries

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, asked, k=10):
    out = {}
    for i in asked:
        v = vectors[ids.index(i)]
        out[i] = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), j) for j, w in zip(ids, vectors) if j != i)[:k]
    return out


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r.vec_id for r in rows], [np.array(r.embedding, np.float64) for r in rows]
    want = brute(ids, vectors, [i for i in ids if i % 100 == 0])
    got = queries.op2_multi_index_hashing(spark, SF).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(by) == set(want) and all(len(v) == 10 and v == sorted(v) for v in by.values())
    hits = sum(len({j for _, j in by[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (10 * len(want)) >= 0.9
    for i, found in by.items():
        for score, j in found:
            assert score == pytest.approx(float(np.sqrt(((vectors[ids.index(i)] - vectors[ids.index(j)]) ** 2).sum())), rel=1e-14)


def test_probing_is_complete():
    random = np.random.default_rng(0)
    vectors = random.standard_normal((500, 40))
    coder = mih.Coder(vectors)
    shard = mih.Shard(np.arange(500), vectors, coder)
    assert shard.codes.shape == (500, 3)
    for radius in (0, 5, 14, 30, 48):
        for q in range(0, 500, 60):
            found = shard.within(shard.codes[q], radius)
            assert found.tolist() == np.flatnonzero(mih.hamming(shard.codes, shard.codes[q]) <= radius).tolist()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD", 3)
    monkeypatch.setattr(mih, "BLOCK", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (200, [0.0, 2.0]), (300, [3.0, 3.0]), (4, None), (500, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (400, [-90.0, 0.0]), (400, [-90.0, 0.5]), (10, [])]
    table = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    asks = table.vec_id % 100 == 0
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in mih.search(table, asks, 3).collect() if r.query_id != 400)
    assert got == [(100, 1, 1), (100, 2, 2), (100, 3, 3), (200, 1, 3), (200, 2, 1), (200, 3, 2), (300, 1, 200), (300, 2, 1), (300, 3, 2)]
    few = mih.search(table.limit(2), asks, 3).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(100, 1)]
    assert mih.search(table.limit(0), asks).count() == 0


def test_recall_and_reranking_at_two_sizes():
    random = np.random.default_rng(7)
    for n, most in ((1500, 0.2), (12_000, 0.16)):
        vectors = random.standard_normal((n, 48))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        sample = vectors[: mih.SAMPLE]
        coder = mih.Coder(sample, rounds=5, copies=mih.COPIES)
        radius = mih.radius_for(sample, coder, 10)
        shard, hits, reranked = mih.Shard(np.arange(n), vectors, coder), 0, 0
        for q in range(0, n, n // 40):
            code = coder.codes(vectors[q : q + 1])[0]
            found = shard.within(code, radius)
            assert found.tolist() == np.flatnonzero(mih.hamming(shard.codes, code) <= radius).tolist()
            far = ((vectors - vectors[q]) ** 2).sum(1)
            far[q] = np.inf
            hits += len(set(np.argsort(far)[:10].tolist()) & set(shard.nearest(q, vectors[q], code, radius, 10)[0].tolist()))
            reranked += len(found)
        asked = len(range(0, n, n // 40))
        # the vectors have no clusters at all, the worst case for the codes
        assert hits / (10 * asked) >= 0.9 and reranked / (asked * n) <= most
