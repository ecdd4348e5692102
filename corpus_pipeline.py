"""The corpus pipeline: documents that a quality classifier keeps, without copies and benchmark passages, packed.

All stages but the last return the columns of documents, so any of them can be left out or run on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of four folds, scores 0.3 or more (keep_good)."""
    from curatrix.llm.quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest, then smallest id (exact_dedup)."""
    from curatrix.llm.exact_dedup import exact_dedup

    return exact_dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies: chains of texts whose sets of five-word runs have
    a similarity of 0.8 or more, found by bit-sliced fingerprints (simhash_dedup)."""
    from curatrix.llm.simhash import simhash_dedup

    return simhash_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, whole or paraphrased (decontaminated)."""
    from curatrix.llm.decontam import decontaminated

    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 2,048 tokens, with its sequence and place there (packed)."""
    from curatrix.llm.packing import packed

    return packed(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL: the classifier, the latent search and the packing are iterative.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; each one's result is written and read again. Every stage takes nulls
    in any column, empty and very long texts, repeated rows and ids, columns of any other name, and empty tables, as its
    operator's docstring says; rows without an id may go as exact copies, but never as near copies or leaks, and are packed like all others."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
