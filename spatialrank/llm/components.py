"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``comp``, the smallest id reachable, for every end of ``edges(a, b)``.

    Every round takes the smallest label among a node's neighbours and then the label of its label, so the
    number of rounds grows with the logarithm of a component's width.  Each round is written to the shared
    folder.  A hub's edges are a skewed join key, which adaptive execution splits; minima are taken before
    the shuffle.  Self-loops and repeated edges change nothing; no edges give no rows.
    """
    both = scratch.materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = scratch.materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jumped = lower.join(labels.select(F.col("id").alias("low"), F.col("comp").alias("lowest")), "low")
        after = scratch.materialize(jumped.select("id", F.least("low", "lowest").alias("now"), "comp"), "labels")
        scratch.release(labels.sparkSession)
        changed = after.where("now <> comp").limit(1).count()
        labels = after.select("id", F.col("now").alias("comp"))
        if not changed:
            return labels
