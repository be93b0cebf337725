"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct shingles of ``WORDS`` words.  Two sets link where
``100 * |intersection| >= 75 * |union|``; then they differ in at most (a + b) / 7 shingles, a and b being their
sizes.

Sizes fall into bands ``[l, 4l/3]``, so linked sets lie in one band or in two neighbours; each set gets the
signatures of its own band and of the next.  A band whose sizes reach r has the Hamming bound k = 2r / 7.
The domain of shingles is split, by hash, into n1 partitions and each of these into n2 parts.  At most
K = k / (k2 + 1) partitions can hold more than k2 differences; in each of the others at least n2 - k2 parts are the
same.  So for each partition, every subset of n2 - k2 of its parts is enumerated, and what a set has in it is one
signature: linked sets share at least n1 - K of them.

n2 and k2 are chosen for each band by cost: the number of signatures, and the candidates that they make, estimated from
how many shingles a signature holds (``shape``).  Enumeration (k2 > 0) pays in the bands of short texts; for longer ones
single partitions (n2 = 1, k2 = 0) make so much fewer signatures that they are the cheapest.

A subset in which a set has nothing makes no signature: n1 is over K by ``SPARE``, so that a set of which fewer than
n1 - K partitions are thin (shingles in at most k2 parts) always shares a filled one with whatever links with it; the
rare sets with more emit their empty ones too, which covers links between two such sets.

Signatures travel as packed numbers, a few rows for each batch of documents and bucket.  In a bucket, each group
with the same signature links its first member with the others: as many candidates as members, never all pairs.
Candidates are tried by size and by a parity sketch (512 bits; two sketches can't differ in more bits than
the sets in shingles), and verified on the sets.  Smaller groups are tried in full at once.  Where a group
of more than ``FEW`` isn't one component after that, its pairs across components are tried too, but for members that
must share another signature with each of their partners (``_crossing``), so that no link is lost.
Equal sets collapse before all this: a task emits a set once.

Defined results: null or empty texts and texts without words have n_shingles 0 and link with nothing.  Fewer
than five words are one shingle.  Rows with a null doc_id link with nothing and have a null component_id.  Rows
that share a doc_id are one node: what either links with is linked.  Repeated rows stay.  Very long texts are one set as
any other.  Other columns of the table aren't read.  An empty table gives no rows.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .bytesops import LOWER, _U, mix, range_hashes, slices, text_bytes, words
from .components import components

WORDS, SPARE, WEIGHT, RARE, FEW = 5, 0.5, 4.0, 20.0, 6
#: A broadcast table of routes has at most so many, some 24 bytes each; beyond it the texts are shuffled to them.
MOST_BROADCAST = 400_000
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)


def bands(largest: int = 1 << 40) -> np.ndarray:
    """The lowest size of each band."""
    lows = [1]
    while lows[-1] < largest:
        lows.append(lows[-1] * 4 // 3 + 1)
    return np.array(lows, np.int64)


_LOWS = bands()


@dataclass(frozen=True)
class Shape:
    """How a band is enumerated: at most ``bad`` of the ``n1`` partitions differ in more than ``k2`` of their ``n2`` parts."""

    bad: int
    n1: int
    n2: int
    k2: int
    #: A row for each subset of parts.
    subsets: np.ndarray

    @property
    def cost(self) -> int:
        return self.n1 * len(self.subsets)


def _thin(n1: int, n2: int, k2: int, size: float) -> float:
    """The chance that a partition of a set of ``size`` has shingles in at most k2 of its n2 parts."""
    p = 1 - math.exp(-size / (n1 * n2))
    return sum(math.comb(n2, i) * p**i * (1 - p) ** (n2 - i) for i in range(k2 + 1))


@lru_cache(None)
def shape(band: int) -> Shape:
    """The cheapest enumeration for a band.

    Three things cost: signatures; candidates, as a text of another topic that has half of a set's shingles shares a
    signature of e shingles with a chance of 2 ** -e (``WEIGHT`` times a signature); and rare sets, whose empty signatures
    put unlike sets together (``RARE`` times).  A form that leaves less than a fifth of K as slack isn't taken.
    """
    least, largest = int(_LOWS[max(0, band - 1)]), int(_LOWS[band + 1]) - 1
    k = 2 * largest // 7
    best = None
    for k2 in range(min(k, 3) + 1):
        for n2 in [1] if k2 == 0 else range(k2 + 1, k2 + 4):
            bad = k // (k2 + 1)
            n1 = bad + 1 + math.ceil(SPARE * bad)
            thin = _thin(n1, n2, k2, least)
            slack = n1 * (1 - _thin(n1, n2, k2, int(_LOWS[band]))) - bad
            if k2 and slack < 0.2 * bad:
                continue
            # thin partitions are about normal in number
            spread = math.sqrt(max(n1 * thin * (1 - thin), 1e-9))
            rare = 0.5 * math.erfc((n1 - bad - 0.5 - n1 * thin) / spread / math.sqrt(2))
            subsets = np.array([[i in kept for i in range(n2)] for kept in combinations(range(n2), n2 - k2)], bool)
            cost = n1 * len(subsets) * (1 + WEIGHT * 0.5 ** (largest / n1 * (n2 - k2) / n2) + RARE * rare)
            if best is None or cost < best[0]:
                best = cost, Shape(bad, n1, n2, k2, subsets)
    return best[1]


def shingles(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, counts = words(raw, offsets)
    hashes = range_hashes(raw, starts, ends)
    factors = _FACTORS if width == WORDS else mix(np.arange(1, width + 1, dtype=np.uint64)) | _U(1)
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i, f in enumerate(factors):
        rolled += hashes[i : i + n] * f
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            out.append(mix((hashes[at : at + count] * factors[:count]).sum(keepdims=True) + _U(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    m = mix(s + _U(0x1234567))
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the shingles that fall on it, as 8 integers."""
    odd = np.bincount((mix(s ^ _U(0xABCDEF)) >> _U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _cells(s: np.ndarray, at: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filled parts, numbered over all partitions, where each one's shingles start in the order given last."""
    partition = ((s >> _U(32)) * _U(at.n1)) >> _U(32)
    cell = partition * _U(at.n2) + (((s & _U(0xFFFFFFFF)) * _U(at.n2)) >> _U(32))
    order = np.argsort(cell, kind="stable") if at.n2 > 1 else np.arange(len(s))  # the hashes are sorted
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first].astype(np.int64), first, order


def _own_band(s: np.ndarray) -> int:
    return int(np.searchsorted(_LOWS, len(s), side="right")) - 1


def _sound(cells: np.ndarray, at: Shape) -> int:
    """Partitions that aren't thin."""
    return int((np.bincount(cells // at.n2, minlength=at.n1) > at.k2).sum())


def slack(s: np.ndarray) -> tuple[int, int]:
    """By the band's parity, partitions that aren't thin, over K: how many signatures a set may lose and still share one
    with whatever links with it."""
    out = [0, 0]
    for band in (_own_band(s), _own_band(s) + 1):
        at = shape(band)
        out[band & 1] = _sound(_cells(s, at)[0], at) - at.bad
    return out[0], out[1]


def signatures(s: np.ndarray) -> np.ndarray:
    """The signatures of a set, for its band and the next; the lowest bit is the band's parity."""
    parts = []
    for band in (_own_band(s), _own_band(s) + 1):
        at = shape(band)
        cells, first, order = _cells(s, at)
        held = np.add.reduceat(mix(s ^ _U(band + 1))[order], first)
        if at.n2 == 1:
            places, sums = cells, held
        else:
            table = np.zeros((at.n1, at.n2), np.uint64)
            table.reshape(-1)[cells] = held
            filled = np.zeros((at.n1, at.n2), bool)
            filled.reshape(-1)[cells] = True
            places = np.flatnonzero(np.stack([filled[:, k].any(1) for k in at.subsets], 1))
            sums = np.stack([table[:, k].sum(1, dtype=np.uint64) for k in at.subsets], 1).reshape(-1)[places]
        found = [mix(sums + (places.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))]
        if at.n1 - _sound(cells, at) >= at.n1 - at.bad:
            empty = np.setdiff1d(np.arange(at.cost), places).astype(np.uint64)
            found.append(mix(mix(empty + _U(1)) * _U(2 * band + 3)))
        parts += [x & ~_U(1) | _U(band & 1) for x in found]
    return np.concatenate(parts)


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_SKETCH = [f"s{i}" for i in range(8)]


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, the fingerprint h1, h2 and the sketch of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), 1 << 20):
                sets = shingles(batch.column(1)[s])
                prints = [fingerprint(x) for x in sets]
                sketches = np.stack([sketch(x) for x in sets])
                slacks = [slack(x) if len(x) else (0, 0) for x in sets]
                columns = [batch.column(0)[s], *(pa.array([x[i] for x in slacks], pa.int64()) for i in (0, 1)), pa.array([len(x) for x in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(sketches[:, i].copy()) for i in range(8)], names=["doc_id", "slack0", "slack1", "n", "h1", "h2", *_SKETCH])
        pa.default_memory_pool().release_unused()

    return _ids_and_texts(docs).mapInArrow(task, "doc_id long, slack0 long, slack1 long, n long, h1 long, h2 long, " + ", ".join(f"{x} long" for x in _SKETCH))


def _candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (key, a, b): candidate pairs a < b where key is null, else b is in the large group ``key``, which stands
    for ``a`` signatures; the key's lowest bit is the band's parity."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for s in slices(batch.column(1), 1 << 21):
                ids, parts, kept = batch.column(0)[s].to_pylist(), [], []
                for doc_id, found in zip(ids, shingles(batch.column(1)[s]), strict=True):
                    if len(found) and doc_id is not None and (p := fingerprint(found)) not in met:
                        met.add(p)
                        kept.append(doc_id)
                        parts.append(signatures(found))
                if not kept:
                    continue
                counts = [len(p) for p in parts]
                marks = np.concatenate(parts)
                local = np.repeat(np.arange(len(kept), dtype=np.uint16), counts)
                bucket = ((marks >> _U(32)) * _U(buckets)) >> _U(32)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                low, local, names = (marks & _U(0xFFFFFFFF)).astype("<u4")[order], local[order], np.array(kept, "<i8").tobytes()
                filled = np.flatnonzero(np.diff(edges)).tolist()
                cut = lambda x: pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in filled], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([names] * len(filled), pa.binary()), cut(local), cut(low)], names=["bucket", "names", "members", "marks"])
        pa.default_memory_pool().release_unused()

    def group(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        ids = np.concatenate([np.frombuffer(n, "<i8")[np.frombuffer(m, "<u2")] for n, m in zip(rows["names"], rows["members"], strict=True)])
        marks = np.concatenate([np.frombuffer(m, "<u4") for m in rows["marks"]])
        order = np.lexsort((ids, marks))
        ids, marks = ids[order], marks[order]
        first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        sizes = np.diff(np.append(first, len(marks)))
        several = sizes > 1
        first, sizes = first[several], sizes[several]
        at = np.repeat(first, sizes)
        within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a, b = [ids[at]], [ids[at + within]]
        for gap in range(1, FEW):  # all pairs of small groups
            inside = (np.repeat(sizes, sizes) <= FEW) & (within + gap < np.repeat(sizes, sizes)) & (within > 0)
            a.append(ids[(at + within)[inside]])
            b.append(ids[(at + within + gap)[inside]])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
        large = sizes > FEW
        at, n = first[large], sizes[large]
        # groups with the same members are one group: their key is a hash of the members
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64)))])
        names = (mix(upto[at + n] - upto[at] + n.astype(np.uint64)) & ~_U(1) | marks[at].astype(np.uint64) & _U(1)).view(np.int64)
        names, once, times = np.unique(names, return_index=True, return_counts=True)
        at, n = at[once], n[once]
        places = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys = np.repeat(names, n)
        key = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), keys]), mask=np.arange(len(pairs) + len(keys)) < len(pairs))
        return pa.table({"key": key, "a": np.concatenate([pairs[:, 0], np.repeat(times, n).astype(np.int64)]), "b": np.concatenate([pairs[:, 1], ids[places]])})

    packed = _ids_and_texts(docs).mapInArrow(emit, "bucket int, names binary, members binary, marks binary")
    return packed.groupBy("bucket").applyInArrow(group, "key long, a long, b long")


def _near(a: str, b: str):
    """What two rows that link must fulfil, by sizes and sketches; the columns are prefixed."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in _SKETCH), F.lit(0))
    return (F.least(n, m) * 4 >= F.greatest(n, m) * 3) & (differ * 7 <= n + m)


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns))


def _near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    x, y = _prefixed(nodes, "x_"), _prefixed(nodes, "y_")
    joined = pairs.join(x, pairs.a == x.x_id).join(y, F.col("b") == y.y_id)
    return joined.where(_near("x_", "y_")).select("a", "b").distinct()


def _packed_set(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def _unpacked_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def _packed_parity(s: np.ndarray) -> bytes:
    """The size, and at least two parity bits for each shingle: a power of two, so that it folds to fewer."""
    bits = 1 << max(9, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ _U(0xABCDEF)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _unpacked_parity(data: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(data[:8], "little"), np.frombuffer(data, np.uint64, offset=8)


def _may_link(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    (n, x), (m, y) = a, b
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 7 * int(np.bitwise_count(x ^ y).sum()) <= n + m


def verify(pairs: DataFrame, docs: DataFrame, parity: bool = False) -> DataFrame:
    """Those ``pairs(a, b)`` whose sets link; with ``parity``, those that long parity sketches don't rule out.

    Each document gets its routes: to (a, salt) as ``a`` itself or as a partner.
    Sets are made from the text and shuffled to their routes; a task holds one set at a time and compares partners as they come.  A busy ``a`` is
    salted, 500 partners each.
    """
    spark = docs.sparkSession
    pack, unpack, test = (_packed_parity, _unpacked_parity, _may_link) if parity else (_packed_set, _unpacked_set, _linked)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    left = salts.select(F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "a", F.lit(None).cast("long").alias("b"))
    right = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int").alias("salt"), "a", "b")
    routes = left.union(right).groupBy("doc_id").agg(F.collect_list(F.struct("a", "salt", "b")).alias("routes"))
    routes = scratch.materialize(routes, "routes")
    wanted = F.broadcast(routes) if (routes.agg(F.sum(F.size("routes"))).first()[0] or 0) <= MOST_BROADCAST else routes

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), 1 << 20):
                found = [pack(x) for x in shingles(batch.column(1)[s])]
                rows = [(r["a"], r["salt"], r["b"], data) for data, routes in zip(found, batch.column(2)[s].to_pylist(), strict=True) for r in routes]
                for begin in range(0, len(rows), 500):
                    part = list(zip(*rows[begin : begin + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["a", "salt", "b", "shingles"])

    found = _ids_and_texts(docs).join(wanted, "doc_id").select("doc_id", "text", "routes").mapInArrow(sets, "a long, salt int, b long, shingles binary")
    dealt = found.repartition(scratch.partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            linked = []
            for a, salt, b, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mine = unpack(data)
                if (a, salt) != at:
                    at, held = (a, salt), []
                if b is None:
                    held.append(mine)
                elif any(test(mine, other) for other in held):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in linked], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = scratch.materialize(dealt.mapInArrow(compare, "a long, b long").distinct(), "links")
    del found, dealt, routes, wanted, left, right, salts
    scratch.release(spark)
    return links


def join(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs(doc_id, text)``."""
    spark: SparkSession = docs.sparkSession
    sets = scratch.materialize(set_rows(docs), "sketches")
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.materialize(filled.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), *(F.first(s).alias(s) for s in ("slack0", "slack1", *_SKETCH))), "classes")
    nodes = classes.select(F.col("rep").alias("id"), "n", *_SKETCH)
    slacks = classes.groupBy(F.col("rep").alias("id")).agg(F.min("slack0").alias("slack0"), F.min("slack1").alias("slack1"))
    member = filled.select("doc_id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).select("doc_id", "rep").distinct()
    member = scratch.materialize(member, "members")
    # rows of one doc_id with different texts join their classes
    doubled = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")

    buckets = buckets or max(8, sets.count() // 2500)
    found = scratch.materialize(_candidates(docs, buckets), "candidates")
    scratch.release(spark)
    rep = lambda c: member.groupBy(F.col("doc_id").alias(c)).agg(F.min("rep").alias(f"rep_{c}"))
    stars = found.where("key IS NULL").select("a", "b").distinct().join(rep("a"), "a").join(rep("b"), "b")
    stars = stars.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).where("a < b").distinct()
    stars = scratch.materialize(_near_pairs(stars, nodes), "stars")

    # first each node against the smallest of its partners, then what is still apart
    first = scratch.materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = verify(first, docs).union(doubled)
    label = components(links)
    apart = scratch.materialize(_apart(stars.join(first, ["a", "b"], "left_anti"), label).union(_crossing(found, rep("b"), nodes, slacks, label)).distinct(), "apart")
    # long sketches first: most of these are long texts that share a passage
    links = links.union(verify(verify(apart, docs, parity=True), docs))
    label = components(links)

    own = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    least = own.join(label, own.rep == label.id, "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends have different components so far."""
    x, y = (label.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    with_both = pairs.join(x, "a", "left").join(y, "b", "left")
    return with_both.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def _crossing(found: DataFrame, rep: DataFrame, nodes: DataFrame, slacks: DataFrame, label: DataFrame) -> DataFrame:
    """Near pairs across components in large groups that aren't one component.

    A node that has fewer signatures in such groups than its slack shares a signature with each of its partners
    outside them, where all pairs have been tried or are connected; so only pairs of nodes of which neither is so
    have to be tried here.  That leaves out texts that merely hold a common passage.
    """
    groups = found.where("key IS NOT NULL").select("key", F.col("a").alias("times"), "b").join(rep, "b").groupBy("key", F.col("rep_b").alias("id")).agg(F.sum("times").alias("times"))
    groups = groups.join(label, "id", "left").select("key", "id", "times", F.coalesce("comp", "id").alias("comp"))
    mixed = groups.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    full = scratch.materialize(groups.join(mixed, "key", "left_semi"), "mixed")
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    lost = full.groupBy("id").agg(F.sum(F.when(odd, F.col("times")).otherwise(0)).alias("lost1"), F.sum(F.when(odd, 0).otherwise(F.col("times"))).alias("lost0"))
    open_ids = lost.join(slacks, "id").where("lost0 >= slack0 OR lost1 >= slack1").select("id")
    rows = full.join(open_ids, "id", "left_semi").join(nodes, "id").drop("times")
    x, y = _prefixed(rows, "x_"), _prefixed(rows, "y_")
    joined = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_id") < F.col("y_id")) & (F.col("x_comp") != F.col("y_comp")) & _near("x_", "y_"))
    return joined.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
