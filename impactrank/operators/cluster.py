"""Document clusters: centroids, maximum summaries and their pruning.  Input: members (cluster_id, doc_id) and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prune import mass_exclusive


def members_of(vectors: DataFrame, members: DataFrame) -> DataFrame:
    return vectors.join(members.select("cluster_id", "doc_id"), "doc_id")


def centroid(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster and term, the mean over the documents that have the term, cut to an integer."""
    return members_of(vectors, members).groupBy("cluster_id", "term").agg(F.expr("cast(sum(weight) / count(*) as int)").alias("weight"))


def summary(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster and term, the largest weight."""
    return members_of(vectors, members).groupBy("cluster_id", "term").agg(F.max("weight").alias("weight"))


def summary_mass(vectors: DataFrame, members: DataFrame, alpha: float) -> DataFrame:
    """Summaries cut by mass."""
    return mass_exclusive(summary(vectors, members), "cluster_id", "term", alpha)


def valued(vectors: DataFrame, members: DataFrame, term: str | int) -> DataFrame:
    """Members of each cluster with their weight for one term."""
    return members_of(vectors.where(F.col("term") == F.lit(term)), members).select("cluster_id", "doc_id", "weight")
