"""Benchmark decontamination by the q-gram lemma.

Texts are compared after A-Z became a-z and runs of white space one blank.  An item of m bytes is leaked where a
region of a document is within e = m / ``EDITS_OF`` edits of it.  An edit destroys at most q of the item's
m - q + 1 q-grams, so such a region shares at least  m - q + 1 - q e  of them, on diagonals at most e apart.

Every document's q-grams are looked up in the items' table.  A hit at text position i and item position j lies on
diagonal i - j; diagonals are cut into bands of 2w, each overlapping the next by w > e, so all the hits of a
region fall into one band.  Bands whose count reaches the bound are retained, each with the stretch of text its
hits reach, and verified: the item is aligned inside the stretch by banded dynamic programming, ends of the
stretch free.

Items of fewer than ``Q`` bytes have no q-gram: a document holds one where its text does, found by one automaton of
all of them.

Benchmark items are the stated query set: they go to the tasks in blocks of at most ``BLOCK`` bytes of text, a
fixed bound on what is broadcast, one pass over the documents for each block.  Every item has the edits that keep the
bound positive, m / ``EDITS_OF`` at most: none under 16 bytes, one from there.

Null and empty documents and items match nothing.  Repeated rows are reported each.  Items with equal text are
reported each.  Empty tables give no rows.  Very long texts are searched whole; other columns of both tables aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import _U, LOWER, SPACE, mix, slices, text_bytes

Q, EDITS_OF, BLOCK = 8, 12, 2_000_000
_TABLE_BITS = 22


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(LOWER.tobytes()).split(None)) if text else b""


def edits(m: int) -> int:
    return max(0, min(m // EDITS_OF, (m - Q) // Q))


def _normal_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of all texts in a row and their offsets."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    blank = SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate([[True], blank[:-1]]) | first[:-1] if len(raw) else blank
    keep = ~(blank & before)
    out = raw[keep]
    out[blank[keep]] = 32
    upto = np.concatenate([[0], np.cumsum(keep)])
    return out, upto[offsets]


def _grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each position as one number."""
    n = max(0, len(data) - Q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out = out << _U(8) | data[i : i + n].astype(np.uint64)
    return out


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = items
        self.short = _automaton([(k, text) for k, (_, text) in enumerate(items) if len(text) < Q])
        grams = [_grams(np.frombuffer(text, np.uint8)) for _, text in items]
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        values = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(values, kind="stable")
        self.values, self.first, self.counts = np.unique(values[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << _TABLE_BITS, bool)
        self.filter[(mix(self.values) >> _U(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.lengths = np.array([len(t) for _, t in items])
        self.allowed = np.array([edits(len(t)) for _, t in items])
        self.bound = np.maximum(1, self.lengths - Q + 1 - Q * self.allowed)
        self.half = self.allowed + 1

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of each shared q-gram."""
        grams = _grams(data)
        at = np.flatnonzero(self.filter[(mix(grams) >> _U(64 - _TABLE_BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.values, grams[at]), len(self.values) - 1)
        same = self.values[found] == grams[at]
        at, found = at[same], found[same]
        n = self.counts[found]
        where = np.repeat(self.first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[where], self.place[where]

    def exact(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """Text and item wherever a text holds an item of fewer than Q bytes."""
        if self.short is None:
            return set()
        texts = data.tobytes().decode("latin-1")
        return {(t, k) for t in range(len(offsets) - 1) for _, same in self.short.iter(texts, int(offsets[t]), int(offsets[t + 1])) for k in same}

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Text, item, and the stretch begin, end of each band that reaches its bound."""
        if not len(self.values) or len(data) < Q:
            return []
        at, item, place = self.hits(data)
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[text + 1]
        at, item, place, text = at[inside], item[inside], place[inside], text[inside]
        if not len(at):
            return []
        # the band of the diagonal and the one before, which overlaps it
        band = (at - place) // self.half[item]
        low = int(band.min()) - 1
        width = int(band.max()) - low + 1
        pair = text * len(self.items) + item
        key = np.concatenate([pair * width + (band - low), pair * width + (band - 1 - low)])
        keys, counts = np.unique(key, return_counts=True)
        item = keys // width % len(self.items)
        full = counts >= self.bound[item]
        keys, item = keys[full], item[full]
        text, diagonal = keys // width // len(self.items), (keys % width + low) * self.half[item]
        begin = np.maximum(offsets[text], diagonal - self.allowed[item])
        end = np.minimum(offsets[text + 1], diagonal + 2 * self.half[item] + self.lengths[item] + self.allowed[item])
        return list(zip(text.tolist(), item.tolist(), begin.tolist(), end.tolist(), strict=True))


def _automaton(short: list[tuple[int, bytes]]):
    """An automaton that gives the places of the items with each text, or None if there are none."""
    same: dict[bytes, list[int]] = {}
    for k, text in short:
        same.setdefault(text, []).append(k)
    if not same:
        return None
    found = ahocorasick.Automaton()
    for text, places in same.items():
        found.add_word(text.decode("latin-1"), places)
    found.make_automaton()
    return found


def align(item: np.ndarray, stretch: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Begin, end and edits of the best place of ``item`` in ``stretch``, or None if over ``most`` edits.

    Only the diagonals that a place within ``most`` edits can touch are filled.
    """
    m, n = len(item), len(stretch)
    width = n - m + 2 * most + 1
    if width <= 0:
        return None
    big = m + n + 1
    # column c of the band is text position j = i + c - most
    j = np.arange(width) - most
    cost = np.where((j >= 0) & (j <= n), 0, big)
    origin = j.copy()
    steps = np.arange(width)
    padded = np.concatenate([np.full(most + 1, 256, np.int16), stretch.astype(np.int16), np.full(m + width + 1, 256, np.int16)])
    for i in range(1, m + 1):
        # diagonal: the column stays; deletion of an item byte: from the column to the right
        change = padded[i + steps] != item[i - 1]
        through = cost + change
        dropped = np.append(cost[1:], big) + 1
        from_drop = np.append(origin[1:], 0)
        best = np.where(through <= dropped, through, dropped)
        start = np.where(through <= dropped, origin, from_drop)
        j = steps + i - most
        best = np.where((j >= 0) & (j <= n), best, big)
        # insertions run along the row: a running minimum of cost - column
        slope = best - steps
        low = np.minimum.accumulate(slope)
        holder = np.maximum.accumulate(np.where(slope == low, steps, 0))
        cost, origin = np.where(j <= n, low + steps, big), start[holder]
    j = steps + m - most
    cost = np.where((j >= 0) & (j <= n), cost, big)
    c = int(cost.argmin())
    return (int(origin[c]), int(j[c]), int(cost[c])) if cost[c] <= most else None


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits for each document and item that a region of it holds."""
    spark = docs.sparkSession
    items = [(r.item_id, normal(r.text)) for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator()]
    blocks, size = [[]], 0
    for item in items:
        if item[1]:
            if size and size + len(item[1]) > BLOCK:
                blocks.append([])
                size = 0
            blocks[-1].append(item)
            size += len(item[1])
    out = spark.createDataFrame([], "doc_id long, item_id long, edits int")
    for block in blocks:
        if block:
            out = out.union(_leaks_of(docs, block))
    return out


def _leaks_of(docs: DataFrame, block: list[tuple[int | None, bytes]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                data, offsets = _normal_batch(batch.column(1)[s])
                best = dict.fromkeys(index.exact(data, offsets), 0)
                for t, k, begin, end in index.regions(data, offsets):
                    if best.get((t, k)) == 0:
                        continue
                    found = align(np.frombuffer(index.items[k][1], np.uint8), data[begin:end], int(index.allowed[k]))
                    if found:
                        best[t, k] = min(best.get((t, k), found[2]), found[2])
                keys = sorted(best)
                doc = ids[s].take(pa.array([t for t, _ in keys], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array([index.items[k][0] for _, k in keys], pa.int64()), pa.array([best[x] for x in keys], pa.int32())], names=["doc_id", "item_id", "edits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, item_id long, edits int")
