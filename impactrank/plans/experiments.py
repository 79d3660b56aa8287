"""Sweeps over pruning settings: the grid, its counts, and a runner."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.index import Index, build, memory_model
from ..operators.analyze import throughput
from ..operators.metrics import evaluate
from ..operators.prune import QueryPrune, VectorPrune
from ..operators.search import SearchConfig, search
from ..sources import text
from ..sources.csr import csr_to_vectors, read_csr

# The published sweep points.
QUERY_ALPHA = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)
QUERY_RATIO = (0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
DOC_ALPHA = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45)
DOC_RATIO = (0.1, 0.2, 0.3, 0.4, 0.5)
LIST_ALPHA = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
LIST_RATIO = (0.05, 0.1, 0.2, 0.3)
BOTH_QUERY, BOTH_DOC, BOTH_LIST = (0.5, 0.7, 0.9), (0.9,), (0.9,)


def grid(k: int = 10, kprime: int = 50) -> Iterator[tuple[str, str, VectorPrune, VectorPrune, SearchConfig]]:
    """(phase, id, document knobs, list knobs, search) for the phases Q, D, P, QD, QP."""
    none, plain = VectorPrune(), SearchConfig(k, kprime)
    with_query = lambda **q: SearchConfig(k, kprime, prune=QueryPrune(**q))
    for a in QUERY_ALPHA:
        yield "Q", f"Q_am{a:.2f}", none, none, with_query(alpha=a)
    for r in QUERY_RATIO:
        yield "Q", f"Q_mr{r:.2f}", none, none, with_query(max_ratio=r)
    for a in DOC_ALPHA:
        yield "D", f"D_am{a:.2f}", VectorPrune(alpha=a), none, plain
    for r in DOC_RATIO:
        yield "D", f"D_mr{r:.2f}", VectorPrune(max_ratio=r), none, plain
    for a in LIST_ALPHA:
        yield "P", f"P_am{a:.2f}", none, VectorPrune(alpha=a), plain
    for r in LIST_RATIO:
        yield "P", f"P_mr{r:.2f}", none, VectorPrune(max_ratio=r), plain
    for q in BOTH_QUERY:
        for d in BOTH_DOC:
            yield "QD", f"QD_q{q:.2f}_d{d:.2f}", VectorPrune(alpha=d), none, with_query(alpha=q)
        for p in BOTH_LIST:
            yield "QP", f"QP_q{q:.2f}_p{p:.2f}", none, VectorPrune(alpha=p), with_query(alpha=q)


# The published sweep points of the block-maximum and cluster engines.
BLOCK_ALPHA = (0.5, 0.7, 0.9, 1.0)
BLOCK_DOC_ALPHA = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
BLOCK_DOC_RATIO = (0.1, 0.2, 0.3, 0.4, 0.5)
BLOCK_LIST_RATIO = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
BLOCK_BOTH_DOC_ALPHA, BLOCK_BOTH_QUERY_RATIO = 0.9, 0.1
CLUSTER_BASE_CUT, CLUSTER_FACTOR = 4, (1.15, 1.2, 1.3, 1.5, 1.75, 2.0)
CLUSTER_QUERY_RATIO, CLUSTER_QUERY_CUT = (0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5), (3, 5, 8, 20)
CLUSTER_DOC_ALPHA, CLUSTER_DOC_RATIO = (0.5, 0.7, 0.9, 0.95), (0.1, 0.3, 0.5)
CLUSTER_LIST_RATIO, CLUSTER_CUT = (0.05, 0.1, 0.2, 0.3), (3, 5, 8)
CLUSTER_BOTH_DOC_ALPHA, CLUSTER_BOTH_QUERY_RATIO = 0.9, 0.1


def block_grid(k: int = 10) -> Iterator[tuple[str, str, VectorPrune, VectorPrune, float | None, float]]:
    """(phase, id, document knobs, list knobs, query ratio, block alpha) for the phases B3, B4, B5."""
    none = VectorPrune()
    for a in BLOCK_ALPHA:
        for x in BLOCK_DOC_ALPHA:
            yield "B3", f"B3_am{x:.2f}_a{a:.1f}", VectorPrune(alpha=x), none, None, a
        for r in BLOCK_DOC_RATIO:
            yield "B3", f"B3_mr{r:.2f}_a{a:.1f}", VectorPrune(max_ratio=r), none, None, a
        for r in BLOCK_LIST_RATIO:
            yield "B4", f"B4_mr{r:.2f}_a{a:.1f}", none, VectorPrune(max_ratio=r), None, a
        for ratio in (None, BLOCK_BOTH_QUERY_RATIO):
            yield "B5", f"B5_q{ratio or 0:.2f}_a{a:.1f}", VectorPrune(alpha=BLOCK_BOTH_DOC_ALPHA), none, ratio, a


def cluster_grid() -> Iterator[tuple[str, str, VectorPrune, VectorPrune, float | None, int, float]]:
    """(phase, id, document knobs, list knobs, query ratio, query cut, heap factor) for the phases S1 to S5."""
    none, base = VectorPrune(), CLUSTER_FACTOR[0]
    for factor in CLUSTER_FACTOR:
        yield "S1", f"S1_c{CLUSTER_BASE_CUT}_h{factor:.2f}", none, none, None, CLUSTER_BASE_CUT, factor
    for r in CLUSTER_QUERY_RATIO:
        for cut in CLUSTER_QUERY_CUT:
            yield "S2", f"S2_mr{r:.2f}_c{cut}", none, none, r, cut, base
    for cut in CLUSTER_CUT:
        for x in CLUSTER_DOC_ALPHA:
            yield "S3", f"S3_am{x:.2f}_c{cut}", VectorPrune(alpha=x), none, None, cut, base
        for r in CLUSTER_DOC_RATIO:
            yield "S3", f"S3_mr{r:.2f}_c{cut}", VectorPrune(max_ratio=r), none, None, cut, base
        for r in CLUSTER_LIST_RATIO:
            yield "S4", f"S4_mr{r:.2f}_c{cut}", none, VectorPrune(max_ratio=r), None, cut, base
        for ratio in (None, CLUSTER_BOTH_QUERY_RATIO):
            for factor in (base, CLUSTER_FACTOR[-1]):
                yield "S5", f"S5_q{ratio or 0:.2f}_c{cut}_h{factor:.2f}", VectorPrune(alpha=CLUSTER_BOTH_DOC_ALPHA), none, ratio, cut, factor


def plan_counts(spark: SparkSession) -> DataFrame:
    """Settings per phase of the main engine."""
    return spark.createDataFrame([(p, i) for p, i, *_ in grid()], "phase STRING, exp_id STRING").groupBy("phase").count()


def all_plan_counts(spark: SparkSession) -> DataFrame:
    """(engine, phase, count) of all engines' settings."""
    rows = [("main", x[0]) for x in grid()] + [("block", x[0]) for x in block_grid()] + [("cluster", x[0]) for x in cluster_grid()]
    return spark.createDataFrame(rows, "engine STRING, phase STRING").groupBy("engine", "phase").count()


def run(docs: DataFrame, queries: DataFrame, qrels: DataFrame, phases: tuple[str, ...] = ("Q", "D", "P", "QD", "QP"), k: int = 10, kprime: int = 50) -> DataFrame:
    """One row of measures per setting; settings that share an index build share its cache."""
    spark, rows, held = docs.sparkSession, [], {}
    truth = search(build(docs), queries, SearchConfig(k, kprime)).persist()
    try:
        for phase, name, d, p, s in grid(k, kprime):
            if phase not in phases:
                continue
            if (d, p) not in held:
                for old in held.values():
                    old.postings.unpersist()
                held.clear()
                index = build(docs, d, p)
                index.postings.persist()
                held[d, p] = index
            began = time.perf_counter()
            found = search(held[d, p], queries, s).persist()
            n = found.count()
            took = time.perf_counter() - began
            m = evaluate(found, qrels, truth, k).first()
            rows.append((name, phase, n, took, *(m[c] for c in ("recall", "ndcg", "mrr", "success"))))
            found.unpersist()
    finally:
        truth.unpersist()
        for old in held.values():
            old.postings.unpersist()
    return spark.createDataFrame(rows, "exp_id STRING, phase STRING, hits BIGINT, seconds DOUBLE, recall DOUBLE, ndcg DOUBLE, mrr DOUBLE, success DOUBLE")


def query_latencies(index: Index, queries: DataFrame, config: SearchConfig = SearchConfig(), limit: int = 1000) -> DataFrame:
    """(query_idx, latency_ms): queries run one after the other, each as a job of its own, in order of id.

    A measuring tool: the driver times one query at a time, so a batch of more than
    ``limit`` queries is refused.
    """
    ids = [r[0] for r in queries.select("query_id").distinct().orderBy("query_id").limit(limit + 1).collect()]
    if len(ids) > limit:
        raise ValueError(f"more than {limit} queries to time one by one")
    rows = []
    for number, one in enumerate(ids):
        began = time.perf_counter()
        search(index, queries.where(F.col("query_id") == F.lit(one)), config).collect()  # k rows
        rows.append((number, (time.perf_counter() - began) * 1000))
    return queries.sparkSession.createDataFrame(rows, "query_idx INT, latency_ms DOUBLE")


#: Options of run_config() and their defaults, which prune nothing.
DEFAULTS = {
    "doc_file": "docs.csr", "query_file": "queries.csr", "ground_truth_file": None, "qrels_file": None, "query_ids_file": None, "doc_ids_file": None,
    "k": 10, "kprime": 50, "doc_alpha": 0.0, "doc_max_ratio": -1.0, "doc_fixed_top": -1,
    "list_alpha": -1.0, "list_max_ratio": -1.0, "list_fixed_top": -1, "idf_fraction": -1.0,
    "query_alpha": 0.0, "query_max_ratio": -1.0, "query_fixed_top": -1, "max_windows": None,
    "output": None, "per_query_output": None,
}


def run_config(spark: SparkSession, config: dict) -> DataFrame:
    """One setting from files to measures: read, prune, index, search, write and evaluate.

    Keys are those of DEFAULTS; an unknown one is an error.  Result: queries, hits,
    seconds, queries a second, index bytes, and recall, ndcg, mrr and success where ground truth or
    judgements are given (else null).  ``output`` gets the result lines,
    ``per_query_output`` the latencies.
    """
    if unknown := set(config) - set(DEFAULTS):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    c = DEFAULTS | config
    docs = csr_to_vectors(read_csr(spark, c["doc_file"]))
    queries = csr_to_vectors(read_csr(spark, c["query_file"]), "query_id").persist()
    index = build(docs, VectorPrune(c["doc_alpha"], c["doc_max_ratio"], c["doc_fixed_top"]), VectorPrune(c["list_alpha"], c["list_max_ratio"], c["list_fixed_top"], c["idf_fraction"]))
    index.postings.persist()
    how = SearchConfig(c["k"], c["kprime"], max_windows=c["max_windows"], prune=QueryPrune(c["query_alpha"], c["query_max_ratio"], c["query_fixed_top"]))
    try:
        size = memory_model(index).first()
        n = queries.select("query_id").distinct().count()
        began = time.perf_counter()
        found = search(index, queries, how).persist()
        hits = found.count()
        took = time.perf_counter() - began
        if c["output"]:
            text.write_results(found, c["output"])
        if c["per_query_output"]:
            text.write_latencies(query_latencies(index, queries, how), c["per_query_output"])
        recall = ndcg = mrr = success = None
        if c["ground_truth_file"]:
            truth = text.read_results(spark, c["ground_truth_file"]).withColumnRenamed("query_ord", "query_id")
            recall = metrics.recall(found, truth, c["k"]).first()[0]
        if c["qrels_file"]:
            named = found
            for column, file in (("query_id", c["query_ids_file"]), ("doc_id", c["doc_ids_file"])):
                if file:
                    ids = text.read_lines(spark, file).select(F.col("ordinal").alias(column), F.trim("value").alias("_name"))
                    named = named.join(ids, column).withColumn(column, F.col("_name")).drop("_name")
                else:
                    named = named.withColumn(column, F.col(column).cast("string"))
            qrels = text.read_qrels(spark, c["qrels_file"]).select("query_id", "doc_id", "relevance")
            ndcg, mrr, success = (f(named, qrels, c["k"]).first()[0] for f in (metrics.ndcg, metrics.mrr, metrics.success))
        found.unpersist()
    finally:
        index.postings.unpersist()
        queries.unpersist()
    row = (n, hits, took, throughput(n, took), size["inverted_bytes"], size["forward_bytes"], recall, ndcg, mrr, success)
    return spark.createDataFrame([row], "queries BIGINT, hits BIGINT, seconds DOUBLE, qps DOUBLE, inverted_bytes BIGINT, forward_bytes BIGINT, recall DOUBLE, ndcg DOUBLE, mrr DOUBLE, success DOUBLE")
