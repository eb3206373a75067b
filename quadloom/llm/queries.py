"""The queries of this folder: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language_id, line_dedup, merkle, packing, quality_rules, simhash, substring, toxicity, zstd_quality
from .common import settle
from .language_id import fold
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the page archive that has been damaged by a fixed rule.

    The tables hold one copy of the pages only, so the second one's bytes are
    derived: by the id modulo 97, records are lost (1), have a byte altered (2),
    are cut short by a byte (3), or are followed by a stray record (4).
    """
    part = F.pmod(F.col("page_id"), F.lit(97))

    def damaged(raw: Column) -> Column:
        at = F.octet_length(raw) - 4
        altered = F.concat(F.substring(raw, 1, at - 1), F.lit(b"\x00"), F.substring(raw, at + 1, 4))
        return F.when(part == 1, F.lit(None).cast("binary")).when(part == 2, altered).when(part == 3, F.substring(raw, 1, at + 3)).otherwise(raw)

    laid = settle(merkle.records(table(spark, sf_dir, "pages"), copy=damaged))
    stray = laid.where(F.pmod(F.col("record_id"), F.lit(97)) == 4).select("record_id", "segment", (F.col("offset") + 1).alias("offset"), "length", "digest")
    return merkle.audit(laid, merkle.copies(laid).unionByName(stray))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_deleted", "longest_run", F.length("kept_text").cast("long").alias("kept_chars"), F.md5("kept_text").alias("kept_md5"))


def _labelled_split(spark: SparkSession, sf_dir: str, folds: int, held: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, labels to learn from, documents with held_out)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(fold("doc_id", folds) != held)
    return docs, known, docs.withColumn("held_out", F.coalesce(fold("doc_id", folds) == held, F.lit(False)))


def op5_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known, split = _labelled_split(spark, sf_dir, 4, 2)
    return zstd_quality.score(split, zstd_quality.learn(docs, known)).drop("text")


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(fold("doc_id", 4) != 2))
    split = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return language_id.identify(split, model).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("n_words")


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known, split = _labelled_split(spark, sf_dir, 3, 1)
    return toxicity.score(split, toxicity.learn(docs, known)).drop("text")


def op9_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_merkle_audit, op3_benchmark_decontamination, op4_line_dedup, op5_quality_zstd, op6_language_crf,
        op7_simhash, op8_toxicity_crf, op9_spf_packing, op10_suffix_repetition, pipeline,
    )
}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
