"""Top lists and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top(df: DataFrame, k: int, tie: str) -> DataFrame:
    """The k rows with the largest score. Scores that differ by float noise tie; the smaller tie column goes first."""
    return df.orderBy(F.desc(F.round("score", 9)), F.asc(tie)).limit(k)


def ranked(df: DataFrame, tie: str, name: str = "rank") -> DataFrame:
    """df with ranks from 1. df is a top list: its rows go through one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), F.asc(tie))))


def fuse(semantic: DataFrame, lexical: DataFrame, key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked top lists (key, rank): key, score, semantic_rank, lexical_rank. Ties go to the better semantic, then lexical rank."""
    both = semantic.select(key, F.col("rank").alias("semantic_rank")).join(lexical.select(key, F.col("rank").alias("lexical_rank")), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("semantic_rank") + part("lexical_rank"))
    return both.orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("lexical_rank")).limit(k)
