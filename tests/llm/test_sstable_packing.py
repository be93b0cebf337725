import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from spatialrank.llm import packing, scratch, sstable

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(2**63 - 1, "last"), (-(2**63), "first"), (2**63 - 9, "near the end"), (7, "Hello there, it's fine."), (3, None), (None, "no id"), (-2, ""), (9, "word " * 3000), (7, "Another with the same id"), (11, "é\n\nü  x")]


def expected():
    library = Tokenizer.from_file(PATH)
    mark = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest()).view(np.int64))
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1])))
    start, out = 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, shard string, start int")


def test_round_trip(spark):
    manifest = sstable.write(docs(spark), scratch.folder(spark, "t"), PATH, shards=3)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.start, r.ids) for r in sstable.read(manifest).collect()), key=key)
    assert got == sorted(expected(), key=key)
    digests = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_digests(manifest).collect()), key=key)
    assert digests == [(k, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, s, i in sorted(expected(), key=key)]
    for wanted in (7, 9, None, 12345):
        assert sorted(sstable.lookup(spark, manifest, wanted)) == sorted(i for k, _, i in expected() if k == wanted)
    assert sstable.read(sstable.write(docs(spark, []), scratch.folder(spark, "t"), PATH)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_shard_lookup(n):
    out = io.BytesIO()
    writer = sstable.Writer(out, block_bytes=300)
    rng = np.random.default_rng(0)
    rows = [(int(k), rng.integers(0, 70_000 if k % 5 == 0 else 60_000, rng.integers(0, 40))) for k in np.sort(rng.integers(-5000, 5000, n))]
    for k, ids in rows:
        writer.add(k, ids)
    writer.close()
    data = out.getvalue()
    reader = sstable.Reader(lambda at, size: data[at : at + size], len(data))
    assert reader.n_docs == n
    assert [(k, v.tolist()) for k, v in reader] == [(k, v.tolist()) for k, v in rows]
    for k in list(range(-5000, 5000, 37)) + [k for k, _ in rows[:200]]:
        assert [v.tolist() for v in reader.get(k)] == [v.tolist() for q, v in rows if q == k]
    if n > 1:
        assert sum(reader.may_hold(k) for k in range(10_000, 20_000)) < 500
        with pytest.raises(ValueError):
            writer.add(-9999, np.zeros(1, int))


def brute(counts, capacity):
    items = [n for n, c in enumerate(counts) for _ in range(c)]
    sums = {0}
    for n in items:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_fullest_is_fullest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = np.zeros(41, int)
        counts[rng.integers(1, 41, 5)] += rng.integers(0, 4, 5)
        capacity = int(rng.integers(0, 41))
        chosen = packing.fullest(counts, capacity)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == brute(counts, capacity)


def test_packing(spark):
    rows = [(k, "word " * ((k * 7919) % 1500)) for k in range(300)] + TEXTS
    made = packing.pack_documents(docs(spark, rows), PATH, run=200)
    got, exact = made.drop("doc_id").toPandas(), made.collect()
    library, want = Tokenizer.from_file(PATH), []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(-1 if k is None else k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(want) == sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in exact)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = s["offset"] + s["length"]
        assert s["offset"].iloc[0] == 0 and (s["offset"].iloc[1:].to_numpy() == ends.iloc[:-1].to_numpy()).all() and ends.max() <= 1024
    assert got.sequence_id.nunique() <= 1.03 * got["length"].sum() / 1024
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_one_identifier_over_several_shards(spark):
    rows = [(5, f"text number {i}") for i in range(400)] + [(None, f"no id {i}") for i in range(200)] + [(9, "last"), (5, "text number 3")]
    manifest = sstable.write(docs(spark, rows), scratch.folder(spark, "t"), PATH, shards=6)
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in sstable.read(manifest).collect())
    assert manifest.where("first_id = 5 OR last_id = 5").count() > 1 and len(found) == len(rows)
    assert [k for _, k, _ in found] == [None] * 200 + [5] * 401 + [9]
    assert all(s + n == following for (s, _, n), (following, *_) in zip(found, found[1:]))
    assert len(sstable.lookup(spark, manifest, 5)) == 401 and len(sstable.lookup(spark, manifest, None)) == 200
