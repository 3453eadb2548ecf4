"""Helpers that several operators share: stored intermediate tables, checked broadcasts, fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.session import BROADCAST_ROWS, drop_stored, join_hot, small_or_shuffled, stored, visible, work_dir

__all__ = ["BROADCAST_ROWS", "drop_stored", "fold", "join_hot", "sampled", "small_or_shuffled", "stored", "table", "visible", "work_dir"]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return visible(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` by hash of ``key``; all of them if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * 2**32)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(2**32)) < cut)
