"""Batched top-k inner-product search in one or two stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index
from .prune import QueryPrune, fixed_top, prune_queries
from .scan import best_in_clusters, by_document
from .sizes import BROADCAST_ROWS, bounded_broadcast, is_small
from .topk import pad, top_k

@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    kprime: int = 50
    rerank: bool = True
    pad_zero: bool = False
    max_windows: int | None = None
    prune: QueryPrune = field(default_factory=QueryPrune)
    broadcast_rows: int = BROADCAST_ROWS


def accumulate(postings: DataFrame, queries: DataFrame, small: bool | None = None) -> DataFrame:
    """(query_id, doc_id, score): sums over terms in common, positive ones only.

    Queries go to the postings where their size allows (``small``; counted if not
    given), so lists of common terms are never dealt by term; with window-partitioned
    postings the sum needs no exchange.
    """
    q = queries.select("query_id", "term", F.col("weight").alias("qw"))
    q = bounded_broadcast(q, BROADCAST_ROWS) if small is None else F.broadcast(q) if small else q
    hit = postings.join(q, "term")
    return hit.groupBy("query_id", "window_id", "doc_id").agg(F.sum(F.col("qw").cast("long") * F.col("weight")).alias("score")).where("score > 0")


def rerank(candidates: DataFrame, forward: DataFrame, queries: DataFrame, small: bool | None = None) -> DataFrame:
    """Exact scores of candidate pairs from unpruned vectors and unpruned queries.

    The pool is dealt by document to the vectors; the query side as in accumulate().
    """
    q = queries.select("query_id", "term", F.col("weight").alias("qw"))
    q = bounded_broadcast(q, BROADCAST_ROWS) if small is None else F.broadcast(q) if small else q
    docs = forward.select("doc_id", "term", F.col("weight").alias("dw"))
    scored = candidates.select("query_id", "doc_id").join(docs, "doc_id").join(q, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw").cast("long") * F.col("dw")).alias("score"))
    return scored.where("score > 0")


def search(index: Index, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, rank, doc_id, score) of the best k documents per query."""
    postings = index.postings
    if config.max_windows is not None:
        postings = postings.where(F.col("window_id") < config.max_windows)
    small = is_small(queries, config.broadcast_rows)  # a pruned batch is no larger
    terms = None
    if config.prune != QueryPrune() and config.prune.scope == "indexed":
        asked = queries.select("term").distinct()
        terms = postings.select("term").join(F.broadcast(asked) if small else asked, "term", "left_semi").distinct()
    pruned = prune_queries(queries, config.prune, terms)
    pool = config.kprime if config.kprime > 0 else config.k
    first = top_k(accumulate(postings, pruned, small), pool)
    found = top_k(rerank(first, index.forward, queries, small), config.k) if config.rerank else first.where(F.col("rank") <= config.k)
    if config.pad_zero:
        return pad(found, queries, config.k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def exact(index: Index, queries: DataFrame, k: int = 10, kprime: int = 50, max_windows: int | None = None) -> DataFrame:
    """Exhaustive accumulation, then re-ranking."""
    return search(index, queries, SearchConfig(k, kprime, max_windows=max_windows))


def sequential_pruned(index: Index, queries: DataFrame, prune: QueryPrune, k: int = 10, kprime: int = 50) -> DataFrame:
    """Query pruning rule after rule on all terms, over an unpruned index."""
    return search(index, queries, SearchConfig(k, kprime, prune=QueryPrune(prune.alpha, prune.max_ratio, prune.fixed_top, "all", "all")))


def postings_touched(index: Index, queries: DataFrame) -> DataFrame:
    """Per query, the number of postings its terms read."""
    lengths = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    return queries.join(lengths, "term").groupBy("query_id").agg(F.sum("n").cast("long").alias("touched"))


def mean_postings_touched(index: Index, queries: DataFrame) -> DataFrame:
    """Number of queries, postings they touch in all, and the integer mean."""
    n, total = F.count("*"), F.coalesce(F.sum("touched"), F.lit(0))
    return postings_touched(index, queries).agg(n.alias("queries"), total.cast("long").alias("touched"), F.expr("coalesce(sum(touched), 0) div greatest(count(*), 1)").cast("long").alias("mean"))


def cluster_search(vectors: DataFrame, members: DataFrame, summaries: DataFrame, queries: DataFrame, k: int = 10, query_cut: int = 8, heap_factor: float = 1.0, seeds: int = 2, rows: DataFrame | None = None) -> DataFrame:
    """Approximate search that visits only promising clusters of documents.

    The ``query_cut`` heaviest terms of a query score every cluster by its summary.
    The best ``seeds`` clusters are scored first; their kth document then admits the
    clusters whose summary score times ``heap_factor`` reaches its score (all clusters
    with a common term where the seeds hold fewer than k documents).  Documents of
    admitted clusters get exact scores from whole queries.  A larger factor visits more;
    with whole queries, unpruned summaries and a factor of 1 or more the result is exact.
    ``rows`` are those of scan.by_document(), if they are held.
    """
    q = queries.select("query_id", "term", F.col("weight").alias("qw")).where("qw > 0")
    cut = fixed_top(queries.where("weight > 0"), "query_id", "term", query_cut, signed=True).select("query_id", "term", F.col("weight").alias("qw"))
    product = F.col("qw").cast("long") * F.col("weight")
    bound = summaries.join(bounded_broadcast(cut, BROADCAST_ROWS), "term").groupBy("query_id", "cluster_id").agg(F.sum(product).alias("bound")).where("bound > 0")
    rows = by_document(vectors, members) if rows is None else rows
    first = top_k(bound, seeds, score="bound", key="cluster_id").select("query_id", "cluster_id")
    floor = top_k(best_in_clusters(rows, q, first, k), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    reached = F.coalesce(F.col("bound") * F.lit(float(heap_factor)) >= F.col("floor"), F.lit(True))
    seen = bound.join(floor, "query_id", "left").where(reached).select("query_id", "cluster_id").unionByName(first)
    return top_k(best_in_clusters(rows, q, seen, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
