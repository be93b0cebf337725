"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in the presence of hashed words and of their beginnings (of ``STEMS`` bytes, where the word
goes on), each once more where it comes up ``OFTEN`` times or more.  It is trained from confirmed toxic examples and
unlabelled text: with the class prior p, the risk is

    p R_P(+)  +  max(0, R_U(-) - p R_P(-))

with the sigmoid loss; where the second part falls below zero in a step, its gradient is turned round, so the
risk of negatives isn't driven below zero by fitting the positives.  No document is ever taken as clean.

Sample: at most ``most_positive`` toxic and ``most_unlabelled`` other documents, the first by a hash of the
identifier; equal documents count once.  The prior is the share of toxic rows among labelled ones outside the
held-out fold, or is given.  Scoring reads every whole text.

Null and empty texts are scored by the bias alone.  Repeated rows are scored each.  Labels without a
document, null labels and null identifiers teach nothing; of several labels of a document the highest counts.
Without a toxic example the score is the prior, 0 where there are no labels.  Very long texts are scored whole; an
empty table gives no rows; other columns of the table aren't read.

The features of the sample stay on the executors: they count them and send the chosen ones only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .bytesops import LOWER, WORDLIKE, _U, ragged, range_hashes, segment_ids, text_bytes, words
from .learning import Adam, first_ids, map_texts, remainder, sigmoid, texts_of

#: Hashed features are numbers of so many bits; the highest bit is for those that come up often.
BITS, OFTEN = 22, 3
STEMS = (4, 5, 6, 7, 8, 9)


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words and beginnings of each text, repeats included, and the text of each."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, counts = words(raw, offsets, ~WORDLIKE)
    text = segment_ids(counts)
    where = [np.flatnonzero(ends - starts > n) for n in STEMS]
    begins = np.concatenate([starts, *(starts[i] for i in where)])
    stops = np.concatenate([ends, *(starts[i] + n for i, n in zip(where, STEMS, strict=True))])
    hashes = range_hashes(raw, begins, stops)
    hashes[len(starts) :] ^= _U(0x5BD1E9955BD1E995)  # a beginning isn't the word of the same letters
    return (hashes >> _U(65 - BITS)).astype(np.int64), np.concatenate([text, *(text[i] for i in where)])


def _features(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted keys, text << BITS | feature, each once."""
    keys, counts = np.unique(at << BITS | found, return_counts=True)
    return np.sort(np.concatenate([keys, keys[counts >= OFTEN] | 1 << (BITS - 1)]))


def _different(texts: pa.Array) -> list[pa.Array]:
    keys = _features(*occurrences(texts))
    return [ragged((keys & ((1 << BITS) - 1)).astype(np.int32), np.bincount(keys >> BITS, minlength=len(texts)))]


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score for each row of ``docs(doc_id, text)``."""
        buckets, weights, bias = self.buckets, self.weights, self.bias
        made: list[tuple[np.ndarray, np.ndarray]] = []  # once in each task

        def function(texts: pa.Array) -> list[pa.Array]:
            if not made:
                weight = np.zeros(1 << BITS, np.float32)
                weight[buckets] = weights
                used = weight != 0
                used[: 1 << (BITS - 1)] |= used[1 << (BITS - 1) :]
                made.append((weight, used))
            weight, used = made[0]
            found, at = occurrences(texts)
            kept = used[found]
            keys = _features(found[kept], at[kept])
            return [pa.array(sigmoid(np.bincount(keys >> BITS, weight[keys & ((1 << BITS) - 1)], minlength=len(texts)) + bias))]

        return map_texts(docs, function, "score double")


def risk_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step follows: the slopes of the risk by the outputs for positives and for unlabelled, or, where the risk
    of negatives is below zero, those of its rise."""
    sp, su = sigmoid(zp), sigmoid(zu)
    slope_p, slope_u = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    # loss as positive: 1 - s; as negative: s
    if su.mean() - prior * sp.mean() >= 0:
        return -2 * prior * slope_p, slope_u
    return prior * slope_p, -slope_u


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, batch: int = 512, rate: float = 0.03, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative risk estimator; rows are examples."""
    random = np.random.default_rng(seed)
    # the sigmoid loss is flat far out, so start between the means
    middles = positive.mean(0, dtype=np.float64), unlabelled.mean(0, dtype=np.float64)
    w = 4 * (middles[0] - middles[1])
    w /= max(1e-9, np.sqrt(np.abs(w).sum()))
    b = np.array([-w @ (middles[0] + middles[1]) / 2])
    adam = Adam([w, b], rate)
    for _ in range(steps):
        p = positive[random.integers(0, len(positive), batch)].astype(np.float64)
        u = unlabelled[random.integers(0, len(unlabelled), batch)].astype(np.float64)
        gp, gu = risk_slopes(p @ w + b, u @ w + b, prior)
        adam.update([p.T @ gp + u.T @ gu + decay * w, np.array([gp.sum() + gu.sum()])])
    return w, float(b[0])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, prior: float | None = None, most_positive: int = 2000, most_unlabelled: int = 4000, features: int = 1024) -> Model:
    """Learn from labels and texts outside the fold ``held_out``."""
    labels = labels.where((remainder(folds) != held_out) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    toxic = first_ids(labels.where("toxic = 1"), most_positive)
    others = first_ids(docs.where(remainder(folds) != held_out).select("doc_id"), most_unlabelled)
    known = set(toxic)
    others = [i for i in others if i not in known]
    found = map_texts(texts_of(docs, toxic + others), _different, "features array<int>")
    marks = docs.sparkSession.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in others], "doc_id long, toxic int")
    sample = scratch.materialize(found.join(F.broadcast(marks), "doc_id").select("toxic", "features").distinct(), "toxicsample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    chosen, shares = choose(sample, sizes[1], sizes[0], features)
    # only the chosen features of the sample come to the driver
    kept = sample.select("toxic", F.array_intersect("features", F.lit(chosen).cast("array<int>")).alias("features")).collect()
    groups = [sorted(r.features for r in kept if r.toxic == k) for k in (1, 0)]
    return fit(*groups, chosen, shares, prior)


def choose(sample: DataFrame, positives: int, others: int, most: int) -> tuple[list[int], list[float]]:
    """The features of ``sample(toxic, features)`` whose shares of the two groups differ most, in ascending order, and
    their shares of the unlabelled; those of fewer than three documents don't count."""
    each = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"))
    p, u = (F.col("p") + 0.5) / (positives + 1), (F.col("u") + 0.5) / (others + 1)
    rows = each.where("p + u >= 3").select("feature", (F.abs(p - u) / F.sqrt(p + u)).alias("strength"), u.alias("share")).where("strength > 0")
    top = sorted((r.feature, r.share) for r in rows.orderBy(F.desc("strength"), "feature").limit(most).collect())
    return [f for f, _ in top], [s for _, s in top]


def fit(positive: list[list[int]], unlabelled: list[list[int]], chosen: list[int], shares: list[float], prior: float) -> Model:
    """Weigh the chosen features by rarity, and learn; examples are lists of features among ``chosen``."""
    chosen = np.array(chosen, np.int64)
    # a feature of many documents says little by itself: it counts by how rare it is
    rarity = np.sqrt(np.maximum(0.0, -np.log(np.minimum(1, np.array(shares)))) / 8)
    matrices = []
    for group in (positive, unlabelled):
        m = np.zeros((len(group), len(chosen)), np.float32)
        for i, s in enumerate(group):
            m[i, np.searchsorted(chosen, s)] = 1
        matrices.append(m * rarity.astype(np.float32))
    w, b = nnpu(*matrices, prior)
    return Model(chosen, w * rarity, b)
