"""Block-maximum filtering: skip document blocks whose upper bound cannot reach the top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.index import Index, lists_of
from ..operators.sizes import BROADCAST_ROWS, bounded_broadcast, is_small

BLOCK = 8


def block_maxima(index: Index, block: int = BLOCK) -> DataFrame:
    """(term, block_id, top): the largest weight of each term in each block; made once for an index."""
    rows = index.postings.select("term", F.expr(f"doc_id div {block}").alias("block_id"), "weight")
    return rows.groupBy("term", "block_id").agg(F.max("weight").alias("top"))


def _ranked(scored: DataFrame, score: str, key: str, largest: int) -> DataFrame:
    """The k best rows of each key of the sweep, k as each row has it; tasks keep ``largest`` before rows are dealt."""
    w = Window.partitionBy("setting", "query_id").orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= largest) & (F.col("rank") <= F.col("k")))


def by_block(index: Index, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, doc_id, weight, block_id): the postings that queries read, dealt by block once.

    Maxima, bounds and scores are all sums within a block, so no later step moves postings.
    """
    rows = lists_of(index.postings.select("term", "doc_id", "weight"), queries)
    return rows.withColumn("block_id", F.expr(f"doc_id div {block}")).repartition("block_id")


def _search(rows: DataFrame, q: DataFrame, maxima: DataFrame | None, largest: int) -> DataFrame:
    """(setting, query_id, rank, doc_id, score) for query rows (setting, query_id, term, qw, alpha, k) and rows of by_block().

    A first pass scores the blocks with each query's highest bounds; its kth score
    then admits the blocks whose bound times alpha reaches it.
    """
    # Rows dealt by block meet admitted (setting, query, block) keys where they are.
    q.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    few = is_small(q.select("setting", "query_id").distinct(), BROADCAST_ROWS // largest)
    sent = F.broadcast if few else lambda df: df
    q = bounded_broadcast(q)
    if maxima is None:
        maxima = rows.groupBy("block_id", "term").agg(F.max("weight").alias("top"))
    run = ["setting", "query_id", "alpha", "k"]
    best = maxima.join(q, "term").groupBy(*run, "block_id")
    bound = best.agg(F.sum(F.col("qw").cast("long") * F.greatest("top", F.lit(0))).alias("bound"))
    seed = _ranked(bound, "bound", "block_id", largest).select("setting", "query_id", "block_id")

    def scored(admitted: DataFrame) -> DataFrame:
        hit = rows.join(q, "term").join(admitted, ["setting", "query_id", "block_id"], "left_semi")
        return hit.groupBy(*run, "block_id", "doc_id").agg(F.sum(F.col("qw").cast("long") * F.col("weight")).alias("score")).where("score > 0")

    last = _ranked(scored(sent(seed)), "score", "doc_id", largest).where(F.col("rank") == F.col("k"))
    floor = last.select("setting", "query_id", F.col("score").alias("floor"))
    reached = F.coalesce(F.col("bound") * F.col("alpha") >= F.col("floor"), F.lit(True))
    admitted = bound.join(sent(floor), ["setting", "query_id"], "left").where(reached).select("setting", "query_id", "block_id")
    out = _ranked(scored(admitted.hint("shuffle_hash")), "score", "doc_id", largest)  # not sorted: hits are many
    return out.select("setting", "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def heaviest_share(queries: DataFrame, beta: float) -> DataFrame:
    """Query rows (query_id, term, qw) of the ceil(beta * n) heaviest of a query's n positive terms."""
    q = queries.select("query_id", "term", F.col("weight").alias("qw")).where("qw > 0")
    if beta >= 1:
        return q
    order = Window.partitionBy("query_id").orderBy(F.col("qw").desc(), "term")
    q = q.withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).withColumn("_r", F.row_number().over(order))
    return q.where(F.col("_r") <= F.ceil(F.col("_n") * F.lit(float(beta)))).drop("_n", "_r")


def blockmax_search(index: Index, queries: DataFrame, k: int = 10, block: int = BLOCK, alpha: float = 1.0, beta: float = 1.0, maxima: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Top k by first-stage scores; alpha = 1 is exact for the query terms kept, smaller values skip more.

    ``rows`` are those of by_block(), if they are held; without ``maxima`` those of the queries' terms are made.
    """
    q = heaviest_share(queries, beta).select(F.lit(0).alias("setting"), "query_id", "term", "qw", F.lit(float(alpha)).alias("alpha"), F.lit(k).alias("k"))
    out = _search(by_block(index, queries, block) if rows is None else rows, q, maxima, k)
    return out.select("query_id", "rank", "doc_id", "score")


def blockmax_sweep(index: Index, queries: DataFrame, settings: Sequence[tuple[float, float, int]], block: int = BLOCK, maxima: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(alpha, beta, k, query_id, rank, doc_id, score) of every setting (alpha, beta, k), in one plan over one index."""
    q = None
    for number, (alpha, beta, k) in enumerate(settings):
        part = heaviest_share(queries, beta).select(F.lit(number).alias("setting"), "query_id", "term", "qw", F.lit(float(alpha)).alias("alpha"), F.lit(k).alias("k"))
        q = part if q is None else q.unionByName(part)
    out = _search(by_block(index, queries, block) if rows is None else rows, q, maxima, max(k for _, _, k in settings))
    names = queries.sparkSession.createDataFrame([(i, float(a), float(b), k) for i, (a, b, k) in enumerate(settings)], "setting INT, alpha DOUBLE, beta DOUBLE, k INT")
    return out.join(F.broadcast(names), "setting").select("alpha", "beta", "k", "query_id", "rank", "doc_id", "score")
