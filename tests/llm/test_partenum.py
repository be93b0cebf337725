import re

import numpy as np
import pyarrow as pa
import pytest

from spatialrank.llm import partenum
from spatialrank.llm.components import components


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(k, word_set(t)) for k, t in rows]
    root = {k: k for k, _ in sets if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = [(k, s) for k, s in sets if k is not None and s]
    for i, (a, s) in enumerate(ids):
        for b, t in ids[i + 1 :]:
            n = len(s & t)
            if n and 100 * n >= 75 * (len(s) + len(t) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


def made(seed, n):
    random = np.random.default_rng(seed)
    word = lambda size: [f"w{x}" for x in random.integers(0, 400, size)]
    passage, texts = word(60), []
    while len(texts) < n:
        base = word(int(random.integers(1, 150)))
        if random.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(" ".join(base))
        for _ in range(int(random.integers(0, 5))):
            near = list(base)
            for _ in range(int(random.integers(0, max(2, len(near) // 14)))):
                near[int(random.integers(0, len(near)))] = word(1)[0]
            texts.append(" ".join(near[int(random.integers(0, 2)) :]))
    return [(int(i) * 3, t) for i, t in zip(random.permutation(len(texts)), texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(partenum, "FEW", 2 if seed == 1 else 6)
    rows = made(seed, 150) + [(None, "a b c d e"), (None, None), (1001, None), (1002, ""), (1003, " \t\n"), (1004, "A b"), (1005, "a  B"), (1006, "a b c d e"), (1007, "a b C d e"), (1008, "q"), (1008, "Q"), (1008, "a b c d e"), (1009, "é\n日本 x"), (1010, "word " * 30000), (1011, "Word\n" * 40000)]
    docs = spark.createDataFrame([(k, t, 7, "c") for k, t in rows], "doc_id long, text string, n int, comp string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in partenum.join(docs).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert len({c for *_, c in got}) < len(got) - 30
    if seed == 1:
        assert partenum.join(docs.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    random = np.random.default_rng(4)
    for _ in range(400):
        n = int(random.integers(1, 60 if random.random() < 0.7 else 800))
        a = random.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        drop, add = int(random.integers(0, n // 5 + 1)), int(random.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate([a[drop:], random.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size
            differ = np.bitwise_count((partenum.sketch(a) ^ partenum.sketch(b)).view(np.uint64)).sum()
            assert differ * 7 <= len(a) + len(b)
            assert partenum._may_link(*(partenum._unpacked_parity(partenum._packed_parity(x)) for x in (a, b)))
            assert partenum._linked(*(partenum._unpacked_set(partenum._packed_set(x)) for x in (a, b)))
    far = [random.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64) for _ in range(2)]
    assert not partenum._may_link(*(partenum._unpacked_parity(partenum._packed_parity(np.unique(x))) for x in far))


def test_shingles_count():
    texts = ["a b c d e f a b c d e f", "A b", "", None, "x y z"]
    assert [len(s) for s in partenum.shingles(pa.array(texts))] == [len(word_set(t)) for t in texts]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (9, 5), (20, 3)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3, 20: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slack_is_what_a_set_may_lose():
    random = np.random.default_rng(5)
    for _ in range(300):
        n = int(random.integers(4, 900))
        a = np.unique(random.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        drop, add = int(random.integers(0, n // 8 + 1)), int(random.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([a[drop:], random.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            shared = np.intersect1d(partenum.signatures(a), partenum.signatures(b))
            spare = partenum.slack(a)
            # in the band that both have, at least as many as the slack
            assert any((shared & np.uint64(1) == p).sum() >= max(1, spare[p]) for p in (0, 1))
