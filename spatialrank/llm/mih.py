"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred and turned by learned rotations (iterative quantisation: each rotation is fitted so that the
signs lose least; ``COPIES`` of them from different starts make the code longer than the vector), and the signs are
a binary code.  A code is cut into substrings of ``SUBSTRING`` bits, each indexed in a table of its own.  Where two codes
are within Hamming distance r = a m + b (b < m), one of the first b + 1 of the m substrings differs in at most a bits or one of
the others in at most a - 1.  So probing each table that near retrieves all of them: with every value that
near, or, where the table has fewer different values than that, with those of its values that are.  Codes over
r are dropped, the rest are ranked by their float vectors in double precision.

Vectors are dealt to shards of at most about ``SHARD`` by their row's number, so that no vector or identifier that comes up often
fills one.  The queries, a stated set, are sent to every shard; a task builds a shard's tables once and streams the
queries through them, ``BLOCK`` at a time.  A shard returns each query's best k, so what is shuffled after it
is k rows for a query and shard.

Rotations and radius are fitted on a bounded sample (``SAMPLE`` vectors, the first by a hash of the row's number).  The
radius is the least that holds the share ``RECALL`` of the true neighbours within the sample; in the whole table
neighbours are nearer and lie within it more often.  Queries with fewer than k codes within it in the whole table are
asked again with a larger one, until they have k or there are no more.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or as candidate.  Vectors
of different lengths have no distance: each length is a table of its own.  A row is never its own neighbour; other rows with the same
vector are, at distance 0.  Ties go to the smaller identifier.  Fewer candidates than k give fewer rows.
Null identifiers take no part.  Rows with the same identifier are one another's own row, so they aren't
neighbours of each other; a repeated query has the rows of one.  Empty tables give no rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SUBSTRING, COPIES, SHARD, LEAST, BLOCK, SAMPLE, RECALL = 16, 2, 1 << 17, 8192, 2048, 8000, 0.95


class Coder:
    """Centre and rotations; ``codes`` gives the packed signs as rows of 16-bit substrings."""

    def __init__(self, sample: np.ndarray, rounds: int = 25, seed: int = 0, copies: int = 1):
        width = sample.shape[1]
        self.width = width
        each = -(-width // SUBSTRING) * SUBSTRING
        self.bits = each * copies
        self.centre = sample.mean(0)
        centred = sample - self.centre
        random = np.random.default_rng(seed)
        turns = []
        for _ in range(copies):
            turn = np.linalg.qr(random.standard_normal((each, each)))[0][:width]
            for _ in range(rounds):
                signs = np.where(centred @ turn >= 0, 1.0, -1.0)
                # the nearest orthonormal rows to what maps the vectors on their signs
                u, _, v = np.linalg.svd(centred.T @ signs, full_matrices=False)
                turn = u @ v
            turns.append(turn)
        self.turn = np.hstack(turns)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.centre) @ self.turn >= 0, axis=1).view(">u2").astype(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


_MASKS: dict[int, np.ndarray] = {}


def masks(radius: int) -> np.ndarray:
    """Every 16-bit value of at most ``radius`` bits."""
    if radius not in _MASKS:
        all_values = np.arange(1 << SUBSTRING, dtype=np.uint16)
        _MASKS[radius] = all_values[np.bitwise_count(all_values) <= radius]
    return _MASKS[radius]


def _size(radius: int) -> int:
    return len(masks(radius))


class Shard:
    """The substring tables of a run of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.codes = ids, vectors, coder.codes(vectors)
        self.tables = []
        for column in self.codes.T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            place = np.full(1 << SUBSTRING, -1, np.int32)
            place[values] = np.arange(len(values))
            self.tables.append((order, values, np.append(first, len(order)), place))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Whether each code has a substring as near as one of those within ``radius`` must."""
        hit = np.zeros(len(self.ids), bool)
        most, over = divmod(radius, len(code))
        for t, (value, (order, values, first, place)) in enumerate(zip(code, self.tables, strict=True)):
            near = most if t <= over else most - 1
            if near < 0:
                continue
            if _size(near) < len(values):
                found = place[masks(near) ^ value]
                found = found[found >= 0]
            else:
                found = np.flatnonzero(np.bitwise_count(values ^ value) <= near)
            n = first[found + 1] - first[found]
            hit[order[np.repeat(first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return hit

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The places of all codes within ``radius``."""
        found = np.flatnonzero(self.probed(code, radius))
        return found[hamming(self.codes[found], code) <= radius]

    def nearest(self, own: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and distances of the best k within the radius."""
        found = self.within(code, radius)
        found = found[self.ids[found] != own]
        distance = np.sqrt(((self.vectors[found] - vector) ** 2).sum(1))
        best = np.lexsort((self.ids[found], distance))[:k]
        return self.ids[found][best], distance[best]


def radius_for(sample: np.ndarray, coder: Coder, k: int, share: float = RECALL, queries: int = 300) -> int:
    """The least radius that holds ``share`` of the k nearest within the sample."""
    codes = coder.codes(sample)
    seen = []
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        distance = ((sample - sample[i]) ** 2).sum(1)
        distance[i] = np.inf
        best = np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)]
        seen.append(hamming(codes[best], codes[i]))
    seen = np.sort(np.concatenate(seen)) if seen else np.zeros(0, int)
    return int(seen[min(len(seen) - 1, int(share * len(seen)))]) if len(seen) else coder.bits


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query of ``vectors(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _sound(F.col("v"))).withColumn("number", F.monotonically_increasing_id())
    sizes = {r.width: (r.n, r.asked) for r in rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).collect()}
    found = [_search(rows.where(F.size("v") == width), width, n, k) for width, (n, asked) in sorted(sizes.items()) if asked]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def _search(rows: DataFrame, width: int, n: int, k: int) -> DataFrame:
    """The search among ``n`` vectors of one length."""
    spark = rows.sparkSession
    picked = rows.select("v", F.xxhash64("number").alias("mark")).orderBy("mark").limit(SAMPLE).select("v").toArrow()
    sample = np.asarray(picked.column("v").combine_chunks().flatten()).reshape(-1, width)
    coder = Coder(sample, copies=COPIES)
    radius = radius_for(sample, coder, k)
    shards = max(1, -(-n // SHARD), min(scratch.partitions(spark), -(-n // LEAST)))
    dealt = rows.select(F.pmod("number", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where("asks").select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    parts = []
    while True:
        found = _ask(dealt, asked, shards, coder, radius, k)
        ranked = scratch.materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
        if radius >= coder.bits:
            parts.append(ranked)
            break
        short = asked.join(ranked.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k), "vec_id", "left_anti")
        short = scratch.materialize(short, "short")
        parts.append(ranked.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti"))
        if short.isEmpty():
            break
        asked, radius = short, min(coder.bits, max(2 * radius, 1))
    return reduce(DataFrame.union, parts).select("query_id", "rank", "vec_id", "score")


def _ask(dealt: DataFrame, asked: DataFrame, shards: int, coder: Coder, radius: int, k: int) -> DataFrame:
    """query_id, vec_id and score: each query's best k of each shard within the radius."""
    width = coder.width
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    # a shard's vectors come before its queries
    met = dealt.union(sent).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            numbers, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
            ids, v = np.asarray(batch.column(2)), np.asarray(batch.column(3).flatten()).reshape(-1, width)
            edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])])).tolist()
            for begin, end in zip(edges, [*edges[1:], len(ids)], strict=True):
                if numbers[begin] != at:
                    at, held, shard = numbers[begin], [], None
                if not asks[begin]:
                    held.append((ids[begin:end].copy(), v[begin:end].copy()))
                    continue
                if shard is None and held:
                    shard, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), coder), []
                for first in range(begin, end if shard else begin, BLOCK):
                    last = min(end, first + BLOCK)
                    out = [shard.nearest(i, x, c, radius, k) for i, x, c in zip(ids[first:last].tolist(), v[first:last], coder.codes(v[first:last]), strict=True)]
                    counts = [len(i) for i, _ in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first:last], counts)), pa.array(np.concatenate([i for i, _ in out])), pa.array(np.concatenate([d for _, d in out]))], names=["query_id", "vec_id", "score"])

    return met.select("shard", "asks", "vec_id", "v").mapInArrow(task, "query_id long, vec_id long, score double")


