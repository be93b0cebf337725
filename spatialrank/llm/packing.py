"""Packing documents into training sequences by minimum bin slack.

Each sequence in turn takes the longest piece left and the set of other pieces that leaves the least room:
a subset-sum over the lengths still there, as shifts of one bitset, finds the fullest sum and is walked
back to the lengths that make it.  A filling that can be made several times is made at once.

Documents are cut only where they are longer than a sequence; the first piece is then the shorter one.
Pieces carry lengths only, so packing moves a few dozen bytes for each.  They are dealt out evenly, and each
task packs runs of ``RUN`` pieces; a run leaves at most a few sequences with room, which is the price
(under 0.02 %) for packing in parallel.

Null and empty texts are documents of the end id alone.  Repeated rows are packed each.  No documents: no
rows.  Very long texts are cut into as many pieces as they need; other columns of the table aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import encoder, with_end

#: Pieces that are packed together.
RUN = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of each document with their ids' crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = with_end(*encoder(vocabulary).ids(batch.column(1)), end_id)
            data, keys, at = ids.astype("<u4"), batch.column(0), 0
            rows, piece, start, length, crc = [], [], [], [], []
            for i, n in enumerate(counts.tolist()):
                first = (n - 1) % capacity + 1
                for k in range((n - first) // capacity + 1):
                    begin = first + (k - 1) * capacity if k else 0
                    size = capacity if k else first
                    rows.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(data[at + begin : at + begin + size].tobytes()))
                at += n
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, PIECES)


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``capacity``; ``counts[n]`` pieces have length n."""
    reach, steps = 1, []
    limit = (1 << (capacity + 1)) - 1
    for n in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        left, k = min(int(counts[n]), capacity // n), 1
        while left:
            k = min(k, left)
            steps.append((reach, n, k))
            reach |= reach << (n * k) & limit
            left -= k
            k *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, n, k in reversed(steps):
        if not before >> total & 1:
            total -= n * k
            chosen[n] = chosen.get(n, 0) + k
    return chosen


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece; no length may be over ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    nexts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return sequence, offset
        counts[longest] -= 1
        filling = fullest(counts, capacity - longest) if longest < capacity else {}
        counts[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(int(counts[n]) // k for n, k in filling.items())
        at = 0
        for n, k in sorted(filling.items(), reverse=True):
            took = order[nexts[n] : nexts[n] + k * times].reshape(times, k)
            nexts[n] += k * times
            counts[n] -= k * times
            sequence[took] = used + np.arange(times)[:, None]
            offset[took] = at + n * np.arange(k)
            at += n * k
        used += times


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, run: int = RUN) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with the sequence and the offset of each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, n = TaskContext.get().partitionId() << 36, [], 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal base
            sequence, offset = pack(table.column("length").to_numpy(), capacity)
            out = table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
            base += int(sequence.max()) + 1
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * run:
                whole = pa.Table.from_batches(held)
                yield from packed(whole.slice(0, run))
                held = whole.slice(run).to_batches()
                n -= run
        if n:
            yield from packed(pa.Table.from_batches(held))

    cut = scratch.materialize(pieces(docs, vocabulary, end_id, capacity), "pieces")
    return cut.repartition(max(1, cut.count() // run)).mapInArrow(task, PIECES + ", sequence_id long, offset long")
