"""Training-data pipeline: quality rules, toxicity, exact and near duplicates, packing.

Each stage takes what its predecessor kept, written as parquet and read again; all but the last return
the columns of ``documents``. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import exact_dedup, minhash_join, packing, quality_ledger, toxicity
from panelwright.llm.bpe import public_file
from panelwright.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_ledger.keep_good(docs, "v1")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; fitted on this stage's own input."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    return minhash_join.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    return packing.pack(docs, public_file("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: No counterpart: tokenization, learned scores and column generation have none in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
