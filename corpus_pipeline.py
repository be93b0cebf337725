"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. toxicity      documents that the classifier calls toxic go
2. line_dedup    lines like an earlier line go; a document that loses every line goes
3. near_join     of each group of near-duplicates the smallest doc_id stays
4. decontaminate documents that hold a benchmark item go
5. packing       the rest is packed into sequences

All but the last return the columns of ``documents``.  Documents without words are neither toxic by themselves nor
duplicates; they stay.  A null doc_id is kept by the filters that work by identifier.  Rows that share a doc_id
share its fate; of rows equal in every column the near-duplicate stage keeps one.  Very long texts are scored, cut, compared,
searched and packed whole.  Other columns pass through, whatever their names.  An empty table stays empty at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialrank.llm import decontaminate, line_dedup, packing, partenum, queries, scratch, toxicity


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.5."""
    model = toxicity.train(docs, scratch.table(spark, sf_dir, "labels"))
    toxic = scratch.materialize(model.score(docs).where("score >= 0.5").select("doc_id").distinct(), "toxic")
    return _without(docs, toxic)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their repeated lines removed; n_chars follows the text."""
    cut = line_dedup.dedup(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", length).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    groups = partenum.join(docs.select("doc_id", "text"))
    others = scratch.materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    return _without(docs, others).distinct()


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    leaks = decontaminate.leaks(docs, scratch.table(spark, sf_dir, "benchmark"))
    return _without(docs, scratch.materialize(leaks.select("doc_id").distinct(), "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_join", keep_one_of_each),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: Training, tokenising and alignment are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder."""
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
