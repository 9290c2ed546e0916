"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Defined cases, for every stage: a null text is empty (quality rules reject it); null doc_ids are kept and never taken for
duplicates or leaks; repeated rows count as often as they occur, though rows of one doc_id stay or go together; of equal
documents the one with the smallest doc_id stays; an empty table gives an empty table; other columns, whatever their names,
are handed on by all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenscan.llm import decontaminate, packing, quality_rules, secret_scan, trie_join
from lumenscan.llm._store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy rejects go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return trie_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat or paraphrase a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per packed piece, with doc_id, bin and offsets."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", best_fit_packing)]

#: The latent retrieval and the learnt formats cannot be written in SQL. Tests compare the operators behind the stages with
#: brute-force versions (rules by SQL, links by sets, packing by a naive search) and run the stages one after the other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
