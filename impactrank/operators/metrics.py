"""Retrieval quality at k.  Inputs: results (query_id, rank, doc_id), truth (query_id, rank, doc_id), qrels (query_id, doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of the true top k that was found; queries without truth do not count."""
    want = truth.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    got = results.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    each = want.join(got, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("r"))
    return each.agg(F.round(F.avg("r"), 6).alias("recall"))


def _judged(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per judged query, its ranked relevant documents (rank null where none was found)."""
    top = results.where(F.col("rank") <= k).select("query_id", "rank", "doc_id")
    return qrels.select("query_id", "doc_id", "relevance").join(top, ["query_id", "doc_id"], "left")


def ndcg(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Gain 2**rel - 1, discount log2(rank + 1); the ideal ranks all judged documents."""
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id"))
    row = _judged(results, qrels, k).withColumn("best", ideal)
    per = row.groupBy("query_id").agg(F.sum(F.when(F.col("rank").isNotNull(), gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1.0)).otherwise(0.0)).alias("idcg"))
    return per.where("idcg > 0").agg(F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"))


def mrr(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank of the first relevant document, over judged queries."""
    per = _judged(results, qrels, k).groupBy("query_id").agg(F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"))
    return per.agg(F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def success(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Share of judged queries with a relevant document in the top k."""
    per = _judged(results, qrels, k).groupBy("query_id").agg(F.max(F.when((F.col("relevance") > 0) & F.col("rank").isNotNull(), 1).otherwise(0)).alias("ok"))
    return per.agg(F.round(F.avg("ok"), 6).alias("success"))


def evaluate(results: DataFrame, qrels: DataFrame, truth: DataFrame | None = None, k: int = 10) -> DataFrame:
    """One row with all measures; recall is null without truth."""
    r = recall(results, truth, k) if truth is not None else results.sparkSession.range(1).select(F.lit(None).cast("double").alias("recall"))
    return r.crossJoin(ndcg(results, qrels, k)).crossJoin(mrr(results, qrels, k)).crossJoin(success(results, qrels, k))  # four one-row tables
