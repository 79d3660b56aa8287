"""Canonical long form of sparse vectors, and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS = "doc_id BIGINT, term STRING, weight INT"
QUERIES = "query_id BIGINT, term STRING, weight INT"
CSR = "row_id BIGINT, indices ARRAY<INT>, weights ARRAY<FLOAT>"
QRELS = "query_id STRING, iter STRING, doc_id STRING, relevance INT"
RUN = "query_id STRING, doc_id STRING, rank INT, score DOUBLE, tag STRING"


def require_unique(vectors: DataFrame, id_col: str, term_col: str = "term") -> DataFrame:
    """Fail at run time if an id has a term twice; otherwise pass rows through summed by key.

    Dot products by join need one row per (id, term).
    """
    counted = vectors.groupBy(id_col, term_col).agg(F.first("weight").alias("weight"), F.count("*").alias("n"))
    return counted.where(F.when(F.col("n") > 1, F.raise_error(F.concat_ws(" ", F.lit("duplicate term"), F.col(term_col).cast("string"), F.lit("in"), F.col(id_col).cast("string")))).otherwise(F.lit(True))).drop("n")


def nested(vectors: DataFrame, id_col: str, term_col: str = "term") -> DataFrame:
    """One row per vector: an array of (term, weight) in term order."""
    return vectors.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(term_col, "weight"))).alias("vector"))


def long(vectors: DataFrame, id_col: str) -> DataFrame:
    """Undo nested()."""
    return vectors.select(id_col, F.explode("vector").alias("e")).select(id_col, "e.*")
