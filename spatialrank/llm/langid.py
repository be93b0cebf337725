"""Language identification with string kernels.

The kernel of two texts is the number of n-grams, of one to ``ORDERS`` bytes, that both hold, over the
geometric mean of how many each holds (a blended-spectrum presence kernel; n-grams are hashed to
``SIZE`` places).  Landmarks from the sample give Nyström features, and one-versus-rest kernel ridge regression
over these the score of each language; a batch is scored by two matrix products.

Sample: about ``most_each`` texts of each value of lang, chosen by a hash of the text; at least one text of each,
and equal texts of a language count once.  With more than ``most_languages`` values each gets fewer, so that the fit's matrices stay as large.  Scoring reads every whole text.

A text that is null or has no letter is ``und`` with score 0.  Rows with null lang teach nothing.  With no
row to learn from, every text is ``und``.  Ties go to the value that sorts first.  Repeated rows and very long texts
are scored as any other; an empty table gives no rows; other columns of the table aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .bytesops import LOWER, WORDLIKE, segment_ids, text_bytes
from .learning import map_texts, remainder

ORDERS, SIZE, LANDMARKS = 3, 4096, 192
#: Letters and bytes of other scripts stay, the rest is a blank.
_LETTERS = np.where(WORDLIKE, LOWER, 32).astype(np.uint32)
_LETTERS[48:58] = 32


def presence(texts: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    raw, offsets = text_bytes(texts)
    out = np.zeros((len(texts), SIZE), np.uint8)
    flat = out.reshape(-1)
    letters = _LETTERS[raw]
    base = (segment_ids(np.diff(offsets)) * SIZE).astype(np.int64)
    gram = np.zeros(len(raw), np.uint32)
    for n in range(1, ORDERS + 1):
        gram = gram[: len(raw) - n + 1] << np.uint32(8) | letters[n - 1 :]
        if not len(gram):
            break
        place = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(0x85EBCA6B) >> np.uint32(20)
        at = base[: len(gram)]
        inside = at == base[n - 1 :]  # an n-gram lies in one text
        flat[at[inside] + place[inside]] = 1
    return out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel of each row of ``a`` with each row of ``b``."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    norms = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))
    return (a @ b.T) / norms


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def predict(self, presences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the best language of each row, and its score from 0 to 1."""
        values = np.hstack([_kernel(presences, self.landmarks), np.ones((len(presences), 1), np.float32)]) @ self.weights
        best = values.argmax(1)
        return best, np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang_pred and score for each row of ``docs(doc_id, text)``."""
        model, names = self, np.array([*self.languages, "und"], object)

        def function(texts: pa.Array) -> list[pa.Array]:
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for begin in range(0, len(texts) if len(names) > 1 else 0, 1024):
                s = slice(begin, begin + 1024)
                best[s], score[s] = model.predict(presence(texts[s]))
            return [pa.array(np.where(letter, names[best], "und"), pa.string()), pa.array(np.where(letter, score, 0.0))]

        return map_texts(docs, function, "lang_pred string, score double")


def fit(presences: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3, seed: int = 0) -> Model:
    """Nyström features over landmarks from the rows, and ridge regression one versus rest."""
    names = sorted(set(languages))
    random = np.random.default_rng(seed)
    lang = np.searchsorted(names, languages)
    each = max(1, landmarks // len(names))
    picked = np.sort(np.concatenate([random.permutation(np.flatnonzero(lang == k))[:each] for k in range(len(names))]))
    marks = presences[picked]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    psi = np.hstack([_kernel(presences, marks) @ whiten, np.ones((len(lang), 1))])
    # the targets are 1 for the own language and -1 for the others
    own = np.zeros((len(names), psi.shape[1]))
    np.add.at(own, lang, psi)
    gram = psi.T @ psi + ridge * len(lang) * np.eye(psi.shape[1]) / len(names)
    solved = np.linalg.solve(gram, 2 * own.T - psi.sum(0)[:, None])
    return Model(names, marks, np.vstack([whiten @ solved[:-1], solved[-1:]]).astype(np.float32))


def sample_sizes(languages: int, most_each: int, most_languages: int) -> tuple[int, int]:
    """Documents of each language, and the most in all; rows times landmarks don't grow until each has but one."""
    width = max(languages, LANDMARKS) * max(languages, 1)
    each = max(1, min(most_each, most_each * most_languages * LANDMARKS // width))
    return each, 2 * max(most_each * most_languages, languages)


def train(docs: DataFrame, folds: int = 5, held_out: int = 0, most_each: int = 800, most_languages: int = 100) -> Model:
    """Learn from the text and lang of rows outside the fold ``held_out``."""
    known = docs.where((remainder(folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # by the text, so that many rows with one text or one identifier count as one
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text", F.lit(7)))
    counts = scratch.materialize(known.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n"), F.min("mark").alias("least")), "languages")
    languages = counts.count()
    each, most = sample_sizes(languages, most_each, most_languages)
    scale = 1 << 30
    share = F.greatest(F.lit(1), (F.lit(scale) * F.least(F.lit(1.0), F.lit(float(each)) / F.col("n"))).cast("long"))
    rows = known.join(F.broadcast(counts.select("lang", "least", share.alias("below"))), "lang")
    rows = rows.where((F.pmod("mark", F.lit(scale)) < F.col("below")) | (F.col("mark") == F.col("least")))
    packed = lambda texts: [pa.array([r.tobytes() for r in np.packbits(presence(texts), axis=1)], pa.binary())]
    unique = map_texts(rows, packed, "grams binary", "lang string").distinct()
    got = [(bytes(r.grams), r.lang) for r in unique.orderBy(F.xxhash64("grams", "lang"), "grams", "lang").limit(most).collect()]
    if not got:
        return Model([], np.zeros((0, SIZE), np.uint8), np.zeros((1, 0), np.float32))
    return fit(np.unpackbits(np.frombuffer(b"".join(g for g, _ in got), np.uint8).reshape(len(got), -1), axis=1), [lang for _, lang in got])
