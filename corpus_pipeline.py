"""The corpus pipeline: quality, toxicity, near-duplicates, packing, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.functions.session import drop_stored, scratch, visible
from ledgerline.llm import packing, quality, simhash, toxicity
from ledgerline.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier finds bad."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity score marks."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, five-word shingle sets of similarity 0.8 or more: the one with the smallest doc_id."""
    return simhash.dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document that is left."""
    return packing.pack_documents(docs, small=True)  # its workers hold the other stages' models too


STAGES = [("quality", good), ("toxicity", civil), ("simhash", single), ("packing", packed)]

#: The stages' models and hashes can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows stored before the next reads them.

    What a stage stores on its way goes when its rows are stored, and those go when the next stage's are.
    """
    docs = visible(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            after = stored(stage(spark, docs, sf_dir), name, keep=True)
        drop_stored(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
