"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, each a run of ``PASSAGE`` words described by the figures in ``FIGURES``.  A
hidden layer encodes every passage; gated attention

    a_k  ~  exp( w . (tanh(V h_k) * sigmoid(U h_k)) )

weighs them, with weights learned from document labels alone, and the weighted sum of the encodings is scored.

Sample: at most ``most`` documents of each label, the first by a hash of the identifier; equal ones count
once.  Scoring reads every passage of every whole text.

A text without words is one passage of zeros, so it too has a score.  Labels without a document and null labels
teach nothing; of several labels of a document the lowest counts.  With labels of one kind only, or none, the
score is their share of 1, or 0.5.  Repeated rows and very long texts are scored as any other; an empty table
gives no rows; other columns of the table aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, range_hashes, segment_ids, text_bytes, words
from .learning import Adam, first_ids, map_texts, remainder, sigmoid, texts_of

PASSAGE = 48
FIGURES = ("capitals", "digits", "signs", "odd_signs", "other_scripts", "word_length", "length_spread", "different", "repeats", "lines", "sentence_ends", "capital_words", "size", "wordless", "short_words", "long_words")

_BYTES = np.arange(256)
_LOW, _UP = (_BYTES >= 97) & (_BYTES < 123), (_BYTES >= 65) & (_BYTES < 91)
_DIGIT, _HIGH, _LINE = (_BYTES >= 48) & (_BYTES < 58), _BYTES >= 128, _BYTES == 10
_SIGN = (_BYTES > 32) & (_BYTES < 127) & ~_LOW & ~_UP & ~_DIGIT
_PLAIN = np.isin(_BYTES, [ord(c) for c in ".,;:'\"?()-"])
_END = np.isin(_BYTES, [ord(c) for c in ".?!"])


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The figures of all passages in a row, and how many passages each text has (one at least)."""
    raw, offsets = text_bytes(texts)
    starts, ends, counts = words(raw, offsets)
    number = np.maximum(1, -(-counts // PASSAGE))
    out = np.zeros((number.sum(), len(FIGURES)), np.float32)
    if not len(starts):
        return out, number
    text = segment_ids(counts)
    within = np.arange(len(starts)) - (np.cumsum(counts) - counts)[text]
    first = np.cumsum(number) - number
    passage = first[text] + within // PASSAGE
    n = np.maximum(1, np.bincount(passage, minlength=len(out))).astype(np.float64)
    total = lambda x: np.bincount(passage, x, minlength=len(out))
    in_words = {}
    for name, kind in (("up", _UP), ("low", _LOW), ("digit", _DIGIT), ("sign", _SIGN), ("odd", _SIGN & ~_PLAIN), ("high", _HIGH), ("line", _LINE)):
        upto = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int32)])
        in_words[name] = (upto[ends] - upto[starts]) if name != "line" else np.diff(upto[starts], prepend=upto[starts[:1]])
    size = (ends - starts).astype(np.float64)
    length = np.maximum(1, total(size))
    up, low = total(in_words["up"]), total(in_words["low"])
    hashes = range_hashes(LOWER[raw], starts, ends)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    mean = length / n
    letters = in_words["up"] + in_words["low"] + in_words["high"]
    columns = (
        up / np.maximum(1, up + low), total(in_words["digit"]) / length, total(in_words["sign"]) / length, total(in_words["odd"]) / length, total(in_words["high"]) / length,
        mean / 10, np.sqrt(np.maximum(0, total(size**2) / n - mean**2)) / 10, np.bincount(passage[order][fresh], minlength=len(out)) / n, total(again) / n,
        total(np.minimum(1, in_words["line"])) / n, total(_END[raw[ends - 1]]) / n, total(_UP[raw[starts]]) / n, np.log1p(n) / 4, total(letters == 0) / n, total(size <= 2) / n, total(size >= 16) / n,
    )
    for i, c in enumerate(columns):
        out[:, i] = c
    out[np.setdiff1d(np.arange(len(out)), passage)] = 0
    return out, number


@dataclass
class Model:
    """Encoding (e, f), attention (v, u, w) and output (c, d), after the figures are centred and scaled."""

    centre: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    def forward(self, figures: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        e, f, v, u, w, c, d = self.parts
        x = np.clip((figures - self.centre) / self.scale, -8, 8)
        h = np.tanh(x @ e + f)
        t, g = np.tanh(h @ v), sigmoid(h @ u)
        first = np.cumsum(counts) - counts
        bag = segment_ids(counts)
        energy = (t * g) @ w
        a = np.exp(energy - np.maximum.reduceat(energy, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "first": first, "logit": z @ c + d}

    def gradients(self, figures: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss."""
        e, f, v, u, w, c, d = self.parts
        r = self.forward(figures, counts)
        dl = (sigmoid(r["logit"]) - labels) / len(labels)
        dz = dl[:, None] * c
        dzk = dz[r["bag"]]
        dh = r["a"][:, None] * dzk
        da = (r["h"] * dzk).sum(1)
        energy = r["a"] * (da - np.add.reduceat(r["a"] * da, r["first"])[r["bag"]])
        dtg = energy[:, None] * w
        dt, dg = dtg * r["g"] * (1 - r["t"] ** 2), dtg * r["t"] * r["g"] * (1 - r["g"])
        dh += dt @ v.T + dg @ u.T
        dx = dh * (1 - r["h"] ** 2)
        return [r["x"].T @ dx, dx.sum(0), r["h"].T @ dt, r["h"].T @ dg, (r["t"] * r["g"]).T @ energy, r["z"].T @ dl, np.array([dl.sum()])]

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score for each row of ``docs(doc_id, text)``."""
        model = self

        def function(texts: pa.Array) -> list[pa.Array]:
            figures, counts = passages(texts)
            return [pa.array(sigmoid(model.forward(figures, counts)["logit"]).astype(np.float64))]

        return map_texts(docs, function, "score double")


def fit(figures: np.ndarray, counts: np.ndarray, labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Train by Adam on bags of passages."""
    random = np.random.default_rng(seed)
    width = figures.shape[1]
    shapes = [(width, hidden), (hidden,), (hidden, gates), (hidden, gates), (gates,), (hidden,), (1,)]
    parts = [random.standard_normal(s) / np.sqrt(s[0]) if len(s) > 1 or i in (4, 5) else np.zeros(s) for i, s in enumerate(shapes)]
    model = Model(figures.mean(0).astype(np.float64), np.maximum(figures.std(0), 1e-3).astype(np.float64), parts)
    adam = Adam(parts, rate)
    first = np.cumsum(counts) - counts
    for _ in range(epochs):
        order = random.permutation(len(counts))
        for begin in range(0, len(order), batch):
            bags = order[begin : begin + batch]
            rows = np.repeat(first[bags] - (np.cumsum(counts[bags]) - counts[bags]), counts[bags]) + np.arange(counts[bags].sum())
            gradients = model.gradients(figures[rows], counts[bags], labels[bags])
            adam.update([g + decay * p for g, p in zip(gradients, parts, strict=True)])
    return model


def _bags(texts: pa.Array) -> list[pa.Array]:
    figures, counts = passages(texts)
    parts = np.split(figures, np.cumsum(counts)[:-1])
    return [pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())]


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = 2500) -> Model:
    """Learn from labels and texts outside the fold ``held_out``."""
    labels = labels.where((remainder(folds) != held_out) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    ids = {k: first_ids(labels.where(F.col("quality") == k), most) for k in (0, 1)}
    label = {i: k for k in (0, 1) for i in ids[k]}
    rows = map_texts(texts_of(docs, list(label)), _bags, "bag binary").collect()
    bags = dict.fromkeys(sorted((bytes(r.bag), label[r.doc_id]) for r in rows))
    y = np.array([k for _, k in bags], np.float64)
    if len(set(y)) < 2:
        share = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        width = len(FIGURES)
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.array([np.log(share / (1 - share))])])
    counts = np.array([len(b) // 4 // len(FIGURES) for b, _ in bags])
    figures = np.frombuffer(b"".join(b for b, _ in bags), "<f4").reshape(-1, len(FIGURES))
    return fit(figures, counts, y)
