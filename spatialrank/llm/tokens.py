"""Byte-level BPE of whole texts with the ``tokenizers`` library, each different word encoded once.

BPE never merges across the words that the pre-tokeniser cuts, so a text's ids are its words' ids in
a row.  Here numpy cuts a batch of texts by the same rule, finds the different words, and gives only
those not met before to the library.  A worker keeps what it has met (at most ``MOST_WORDS``).
"""

from __future__ import annotations

import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytesops import _U, mix, segment_ids, slices

#: Words kept by a worker before it starts anew.
MOST_WORDS = 1_500_000
#: Code points with the property White_Space (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _OTHER, _WHITE = range(4)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and its 64-bit code for hashing."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            kinds[i] = _LETTER
        elif major == "N":
            kinds[i] = _NUMBER
    kinds[WHITE] = _WHITE
    return kinds, mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))


def cut(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words start in ``points``; texts start at ``begins`` (the last is the end).

    The rule is that of the vocabulary's pattern: contractions, then runs of letters, of numbers or of
    other signs, each with a space before it, then white space, whose last character stays apart
    where something follows.
    """
    n = len(points)
    kinds = _tables()[0][points]
    start = np.zeros(n + 1, bool)
    start[1:n] = kinds[1:] != kinds[:-1]
    start[begins] = True
    white = kinds == _WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:])  # of a run of white space
    text_start = np.zeros(n + 1, bool)
    text_start[begins] = True
    last = last[~text_start[last + 1]]
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quotes = np.flatnonzero(points == 39)
    for i in quotes[start[quotes]].tolist():
        rest = "".join(map(chr, points[i + 1 : i + 3][np.logical_and.accumulate(~text_start[i + 1 : min(i + 3, n)])]))
        size = 1 if rest[:1] in ("s", "t", "m", "d") and rest else 2 if rest in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """``ids(column)``: the ids of all texts in a row, and how many each text has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.bytes_of = np.ones(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level tokens have one character for each byte
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode the words ``points[starts:ends]`` and keep them by ``keys``."""
        kinds = _tables()[0]
        # a space and letters alone stay one word wherever they stand, so many go to the library as one text
        plain = (points[starts] == 32) & (ends - starts > 1) & (kinds[points[np.minimum(starts + 1, len(points) - 1)]] == _LETTER)
        counts, pieces = np.zeros(len(keys), np.int32), []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        text = points.astype("<u4", copy=False)
        several = np.flatnonzero(plain)
        for part in np.array_split(several, max(1, len(several) // 2000)):
            if not len(part):
                continue
            lengths = ends[part] - starts[part]
            where = np.repeat(starts[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            chars = text[where]
            ids = np.array(self.library.encode_batch_fast([chars.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
            width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            word_end = np.cumsum(np.add.reduceat(width, np.cumsum(lengths) - lengths))
            token_end = np.cumsum(self.bytes_of[ids])
            upto = np.searchsorted(token_end, word_end, side="right")
            counts[part] = np.diff(upto, prepend=0)
            pieces.append(ids)
        single = np.flatnonzero(~plain)
        texts = [text[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in single.tolist()]
        for begin in range(0, len(texts), 5000):
            for i, found in zip(single[begin : begin + 5000].tolist(), self.library.encode_batch_fast(texts[begin : begin + 5000], add_special_tokens=False), strict=True):
                counts[i] = len(found.ids)
                pieces.append(np.array(found.ids, np.uint32))
        at = np.zeros(len(keys), np.int64)
        sizes = counts[order].astype(np.int64)
        at[order] = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *pieces])
        # both are sorted, so the new words go in between
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.count, where, counts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
        begins = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=begins[1:])
        if not begins[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        points = np.frombuffer("".join(x or "" for x in texts.to_pylist()).encode("utf-32-le"), "<u4")
        starts = cut(points, begins)
        ends = np.append(starts[1:], len(points))
        up, down = _code_powers(len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_tables()[1][points] * up[: len(points)], out=total[1:])
        hashes = (total[ends] - total[starts]) * down[starts]
        different, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(different) > MOST_WORDS:
            self._forget()
        found = np.searchsorted(self.keys, different)
        new = np.flatnonzero((found == len(self.keys)) | (self.keys[np.minimum(found, max(0, len(self.keys) - 1))] != different)) if len(self.keys) else np.arange(len(different))
        if len(new):
            self._learn(different[new], points, starts[first[new]], ends[first[new]])
            found = np.searchsorted(self.keys, different)
        at, count = self.at[found][back], self.count[found][back].astype(np.int64)
        out = np.cumsum(count)
        ids = self.flat[np.repeat(at - (out - count), count) + np.arange(out[-1])]
        edges = np.concatenate([[0], out])[np.searchsorted(starts, begins)]
        return ids, np.diff(edges)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Exactly what ``encode(text, add_special_tokens=False)`` gives for each text; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        odd = np.zeros(len(column), bool)
        for token in self.special:  # the library cuts these out before it cuts words
            odd |= np.asarray(pc.match_substring(column, token))
        if odd.any():
            plain, counts = self.ids(pc.if_else(pa.array(odd), "", column))
            parts = np.split(plain, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        parts, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s in slices(column):
            a, b = self._encode(column[s])
            parts.append(a)
            counts.append(b)
        return np.concatenate(parts), np.concatenate(counts)


_POWERS: list[np.ndarray] = []


def _code_powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        base = 0xD6E8FEB86659FD93
        _POWERS[:] = []
        for b in (base, pow(base, -1, 2**64)):
            powers = np.full(n, b, np.uint64)
            powers[0] = _U(1)
            _POWERS.append(np.multiply.accumulate(powers))
    return _POWERS


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each document's."""
    out = np.empty(len(ids) + len(counts), np.uint32)
    ends = np.cumsum(counts + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    out[ends] = end
    return out, counts + 1


__all__ = ["Encoder", "cut", "encoder", "segment_ids", "with_end"]
