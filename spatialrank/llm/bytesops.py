"""Vectorised text primitives: a batch of texts as one byte array, words found and hashed by numpy.

Word hashes are polynomial in the bytes modulo 2**64 over random 64-bit byte codes, then mixed; two
different words share one with probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes other than x20 and x09-x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letter-like words: ASCII letters and digits, and every byte of a non-ASCII character.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 18)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and the offsets of each (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``raw``, and the number of words of each text."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~apart[raw]
    edge = inside[1:] != inside[:-1]
    # texts follow each other without a gap: a word ends where its text does
    inner = offsets[1:-1]
    cut = inner[inside[inner] & inside[inner + 1]] if len(inner) else inner
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each byte range of ``raw``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def segment_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def slices(column: pa.Array, most: int = 1_000_000, rows: int = 60_000) -> Iterator[slice]:
    """Cut a column of texts into runs of at most ``most`` bytes and ``rows`` texts; a longer text is a run of its own."""
    lengths = np.diff(text_bytes(column)[1])
    begin = 0
    size = 0
    for i, n in enumerate(lengths):
        if i > begin and (size + n > most or i - begin >= rows):
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
