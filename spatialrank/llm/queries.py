"""The queries of this package's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, line_dedup, mih, packing, partenum, pii, quality, scratch, sstable, toxicity
from .learning import remainder

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """The path of a public tokeniser's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(scratch.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(scratch.table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write(scratch.table(spark, sf_dir, "documents"), scratch.folder(spark, "shards"), vocabulary())
    return sstable.read_digests(manifest)


def _folds(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(remainder(folds) == held_out, F.lit(False)))


def op4_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    scored = toxicity.train(docs, scratch.table(spark, sf_dir, "labels")).score(docs)
    return _folds(scored, 5, 0).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(scratch.table(spark, sf_dir, "documents"), scratch.table(spark, sf_dir, "benchmark"))


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(scratch.table(spark, sf_dir, "documents"), vocabulary())


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    return _folds(langid.train(docs).score(docs), 5, 0).select("doc_id", "held_out", "lang_pred", "score")


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    scored = quality.train(docs, scratch.table(spark, sf_dir, "labels")).score(docs)
    return _folds(scored, 4, 2).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(scratch.table(spark, sf_dir, "documents"))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(scratch.table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_multi_index_hashing, op3_sstable, op4_nonnegative_pu_toxicity, op5_qgram_decontamination, op6_minimum_bin_slack, op7_string_kernel_language, op8_attention_quality, op9_partenum_join, op10_weak_supervision_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL}
