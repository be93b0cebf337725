"""What the trained classifiers share: bounded samples, folds, batch scoring and Adam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import slices


def remainder(by: int) -> Column:
    """crc32(doc_id as text) mod ``by``; null for a null identifier."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def first_ids(rows: DataFrame, most: int) -> list[int]:
    """At most ``most`` different identifiers, the first in the order of a hash: the same for any partitioning and
    however often each comes up."""
    picked = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [r.doc_id for r in picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def texts_of(docs: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of ``docs`` with one of ``ids``, a bounded list, found by a broadcast join: no text is shuffled."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id", "left_semi")


def map_texts(docs: DataFrame, function: Callable[[pa.Array], list[pa.Array]], fields: str, beside: str = "doc_id long") -> DataFrame:
    """The column ``beside`` and those that ``function`` makes of each text, in Arrow batches of at most some MB."""
    own, kind = beside.split()
    names = [own, *(field.split()[0] for field in fields.split(", "))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for s in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], *function(texts[s])], names=names)

    return docs.select(F.col(own).cast(kind).alias(own), F.col("text").cast("string").alias("text")).mapInArrow(task, f"{beside}, {fields}")


class Adam:
    """Adam over a list of arrays, changed in place."""

    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, (m, v) in zip(self.parameters, gradients, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
