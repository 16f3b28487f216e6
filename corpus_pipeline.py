"""From raw documents to token digests: five stages, each over all that its
predecessor kept.

A stage decides on rows: two rows with one doc_id, or without any, are judged
each by their own text. Columns of documents keep their names, types and values,
whatever they are called: the operators see them under other names. Every stage
takes empty tables (and gives none), null and empty texts (an empty text),
texts of any length, and repeated rows; what it makes of them is said at it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockfold.llm import bpe, decontaminate, exact_dedup, quality, simhash
from stockfold.llm.common import table, written


def chosen(docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``choose`` leaves of ``docs``, with the columns of ``docs``.
    It gets doc_id and text by name, all others under names of no operator."""
    names = [c if c in ("doc_id", "text") else f"own_{k}" for k, c in enumerate(docs.columns)]
    return choose(docs.toDF(*names)).select(names).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under its cut) go. A null or
    empty text is one empty passage and judged as such; rows that repeat are
    judged alike; without labels of both kinds all stay."""
    model = quality.fit(docs, quality.label_rows(spark, sf_dir))
    return chosen(docs, lambda rows: quality.scored(rows, model).where("predicted = 1"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) one row stays: the one with the largest
    doc_id, any id before none; of rows with that id too, one."""
    return chosen(docs, exact_dedup.survivors)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints one document stays: the one with the smallest
    doc_id, any id before none; of several with that id the one whose text has
    the least SHA-256. Empty and null texts are linked like any other. Rows equal
    in doc_id and text are one document, and all stay with it; none are left by
    the stage before."""

    def choose(rows: DataFrame) -> DataFrame:
        key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        gone = simhash.grouped(rows.select("doc_id", "text").withColumn("key", key)).where("not first").select(F.col("doc_id").alias("gone_id"), "key").distinct()
        same = (F.col("r.key") == F.col("g.key")) & F.col("r.doc_id").eqNullSafe(F.col("g.gone_id"))
        return rows.withColumn("key", key).alias("r").join(gone.alias("g"), same, "left_anti")

    return chosen(docs, choose)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go; null and empty texts
    have none and stay; rows that repeat are judged alike."""
    items = table(spark, sf_dir, "benchmark")
    return chosen(docs, lambda rows: decontaminate.contamination(rows, items, unnamed=True).where("not contaminated"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's tokens and of their decoding; a null or empty text has none."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
