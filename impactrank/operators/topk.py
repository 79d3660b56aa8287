"""Bounded ranking; Catalyst keeps k rows per group and task before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "doc_id", ascending: bool = False) -> DataFrame:
    """The k best rows per group with ``rank`` from 1, ties by key; ``ascending`` numbers them from the worst kept."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    kept = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if ascending:
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("rank").desc())))
    return kept


def top_k_distinct(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "doc_id", ascending: bool = False) -> DataFrame:
    """top_k() with one row per key.  Of a key's rows the best counts, since rows have no arrival order here."""
    return top_k(scored.groupBy(by, key).agg(F.max(score).alias(score)), k, by, score, key, ascending)


def pad(ranked: DataFrame, queries: DataFrame, k: int, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Exactly k rows per query: missing ranks hold key 0."""
    slots = queries.select(by).distinct().select(by, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(ranked.select(by, "rank", key), [by, "rank"], "left").select(by, "rank", F.coalesce(key, F.lit(0)).cast("long").alias(key))
