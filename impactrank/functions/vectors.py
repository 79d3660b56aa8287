"""Scalar operations on sparse vectors in long form (id, term, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_arrays(vectors: DataFrame, by: str, term: str = "term") -> DataFrame:
    """(id, terms, weights): each vector as two arrays in term order."""
    held = vectors.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(term, "weight"))).alias("e"))  # one vector's elements
    return held.select(by, F.col(f"e.{term}").alias("terms"), F.col("e.weight").alias("weights"))


def value_of(terms: Column, weights: Column, term: Column) -> Column:
    """Weight of a term in a vector given as arrays; 0 if it is absent."""
    at = F.array_position(terms, term)
    return F.when(at > 0, F.get(weights, (at - 1).cast("int"))).otherwise(F.lit(0))


def values_of_term(vectors: DataFrame, by: str, term: str | int) -> DataFrame:
    """(id, weight): every vector's weight of one term, 0 where it is absent."""
    return vectors.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("term") == F.lit(term), F.col("weight"))), F.lit(0)).alias("weight"))


def total(vectors: DataFrame, by: str) -> DataFrame:
    """(id, total): the signed sum of a vector's weights."""
    return vectors.groupBy(by).agg(F.sum("weight").cast("long").alias("total"))


def impact_order(vectors: DataFrame, by: str, term: str = "term", budget: int | None = None) -> DataFrame:
    """Elements with their ``place`` by weight, largest first, ties by term; ``budget`` keeps the first so many."""
    out = vectors.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("weight").desc(), term)))
    return out if budget is None else out.where(F.col("place") <= budget)
