"""Cleaning pipeline over ``documents``: quality rules, near-duplicates, benchmark
decontamination, secret scans, packing. Each stage is written as Parquet and reread.

Defined cases, for every stage: a null text reads as an empty one; repeated rows and null ids are
judged row by row, and of a group of near-duplicates one row, with the smallest doc_id, stays; texts of any length go through whole; further columns are
kept, whatever they are called, up to the packing, which returns its own columns; an empty table
gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import contamination, packing, quality, secrets, simhash
from pairlens.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first quality rules keep, without their failing lines."""
    return quality.clean_good(docs, size="n_chars" if "n_chars" in docs.columns else None)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each SimHash group."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a finding of any rule."""
    return secrets.without_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, placed in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Stages run regular expressions, fingerprints and a genetic search that SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
