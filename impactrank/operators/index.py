"""The index: unpruned forward vectors, and pruned postings laid out by document window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prune import VectorPrune, prune_docs, prune_lists
from .sizes import bounded_broadcast

WINDOW = 100_000


@dataclass(frozen=True)
class Index:
    """``postings`` (term, doc_id, weight, window_id, local_idx) and ``forward`` (doc_id, term, weight)."""

    postings: DataFrame
    forward: DataFrame
    window: int = WINDOW

    @property
    def terms(self) -> DataFrame:
        return self.postings.select("term").distinct()


def windowed(postings: DataFrame, window: int = WINDOW, layout: bool = False) -> DataFrame:
    """Add window_id and local_idx; ``layout`` also deals rows by window and sorts them by term.

    Groups that include window_id then need no further exchange.
    """
    out = postings.withColumn("window_id", F.expr(f"doc_id div {window}")).withColumn("local_idx", F.expr(f"doc_id % {window}"))
    return out.repartition("window_id").sortWithinPartitions("term", "doc_id") if layout else out


def lists_of(postings: DataFrame, terms: DataFrame | None) -> DataFrame:
    """The postings of the given terms; rows stay where they are if the terms are few."""
    return postings if terms is None else postings.join(bounded_broadcast(terms.select("term").distinct()), "term", "left_semi")


def build(docs: DataFrame, doc_prune: VectorPrune = VectorPrune(), list_prune: VectorPrune = VectorPrune(), window: int = WINDOW, layout: bool = False, drop_zero: bool = False, terms: DataFrame | None = None) -> Index:
    """Prune documents, invert, prune lists, lay out.  Re-ranking uses the vectors as given.

    ``terms`` builds the lists of these terms only, equal to those of the whole index.
    """
    postings = lists_of(prune_lists(lists_of(prune_docs(docs, doc_prune), None if list_prune.longest > 0 else terms), list_prune), terms)
    if drop_zero:
        postings = postings.where("weight <> 0")
    return Index(windowed(postings, window, layout), docs, window)


#: Batch number of what save() and append() write; a stream numbers its own from 0.
WHOLE = -1


def write_postings(postings: DataFrame, path: str, batch: int, mode: str, replace: str = "static") -> None:
    """Postings in folders by window, then batch, sorted by term, so term filters skip row groups."""
    dealt = postings.withColumn("batch", F.lit(batch).cast("long")).repartition("window_id").sortWithinPartitions("term", "doc_id")
    dealt.write.partitionBy("window_id", "batch").option("partitionOverwriteMode", replace).mode(mode).parquet(f"{path}/postings")


def write_forward(forward: DataFrame, path: str, batch: int, mode: str, replace: str = "static") -> None:
    dealt = forward.withColumn("batch", F.lit(batch).cast("long")).repartition("doc_id").sortWithinPartitions("doc_id", "term")
    dealt.write.partitionBy("batch").option("partitionOverwriteMode", replace).mode(mode).parquet(f"{path}/forward")


def save(index: Index, path: str) -> None:
    """Persist as Parquet, in the layout that append() and the streaming ingest add to."""
    write_postings(index.postings, path, WHOLE, "overwrite")
    write_forward(index.forward, path, WHOLE, "overwrite")


def load(spark: SparkSession, path: str, window: int = WINDOW) -> Index:
    postings = spark.read.parquet(f"{path}/postings").withColumn("window_id", F.col("window_id").cast("long")).drop("batch")
    return Index(postings, spark.read.parquet(f"{path}/forward").drop("batch"), window)


def append(spark: SparkSession, path: str, docs: DataFrame, window: int = WINDOW, doc_prune: VectorPrune = VectorPrune()) -> None:
    """Add documents to a saved index, their postings pruned by document; list rules need the whole index."""
    write_postings(windowed(prune_docs(docs, doc_prune), window), path, WHOLE, "append")
    write_forward(docs, path, WHOLE, "append")


def update_vectors(forward: DataFrame, changed: DataFrame) -> DataFrame:
    """Vectors with those of the documents in ``changed`` replaced whole."""
    return forward.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(changed.select(forward.columns))


def doc_range(forward: DataFrame, first: int, end: int) -> DataFrame:
    """Vectors with first <= doc_id < end."""
    return forward.where((F.col("doc_id") >= first) & (F.col("doc_id") < end))


def memory_model(index: Index) -> DataFrame:
    """Bytes by closed form: lists 2 + 24 a term, 24 a window and 8 a posting; vectors 24 each and 3 an element."""
    spans = index.postings.agg((F.max("window_id") + 1).alias("windows"), F.count("*").alias("postings"), F.countDistinct("term").alias("terms"))
    docs = index.forward.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("elements"))
    return spans.crossJoin(docs).select((F.col("terms") * (26 + 24 * F.col("windows")) + 8 * F.col("postings")).cast("long").alias("inverted_bytes"), (24 * F.col("docs") + 3 * F.col("elements")).cast("long").alias("forward_bytes"))


def list_stats(postings: DataFrame) -> DataFrame:
    """Number of terms; integer mean, longest and shortest list."""
    return postings.groupBy("term").agg(F.count("*").alias("n")).agg(F.count("*").alias("terms"), F.expr("sum(n) div count(*)").cast("long").alias("avg_len"), F.max("n").alias("max_len"), F.min("n").alias("min_len"))
