"""Search against brute force, and plan shape."""

import random

from impactrank.operators import index, metrics, search
from impactrank.operators.prune import QueryPrune, VectorPrune
from impactrank.operators.search import SearchConfig
from impactrank.plans.blockmax import blockmax_search


def corpus(spark, n=60, terms=25, seed=1):
    rng = random.Random(seed)
    docs = {d: {t: rng.randint(0, 20) for t in rng.sample(range(terms), 8)} for d in range(n)}
    queries = {q: {t: rng.randint(1, 20) for t in rng.sample(range(terms), 4)} for q in range(6)}
    make = lambda x, c: spark.createDataFrame([(i, t, w) for i, v in x.items() for t, w in v.items()], f"{c} BIGINT, term INT, weight INT")
    return docs, queries, make(docs, "doc_id"), make(queries, "query_id")


def brute(docs, queries, k):
    out = {}
    for q, qv in queries.items():
        s = [(sum(w * dv.get(t, 0) for t, w in qv.items()), d) for d, dv in docs.items()]
        out[q] = [(d, x) for x, d in sorted(((x, d) for x, d in s if x > 0), key=lambda p: (-p[0], p[1]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_exact_equals_brute_force_for_any_window(spark):
    docs, queries, d, q = corpus(spark)
    for window in (7, 1000):
        assert found(search.exact(index.build(d, window=window, layout=True), q, 10, 60)) == brute(docs, queries, 10)
    assert found(search.search(index.build(d), q, SearchConfig(10, 60, broadcast_rows=0))) == brute(docs, queries, 10)


def test_block_max_is_exact_at_alpha_one(spark):
    docs, queries, d, q = corpus(spark, 80)
    assert found(blockmax_search(index.build(d), q, 5, block=4)) == brute(docs, queries, 5)


def test_padding_and_few_hits(spark):
    d = spark.createDataFrame([(5, 1, 3), (6, 1, 2), (7, 1, 1)], "doc_id BIGINT, term INT, weight INT")
    q = spark.createDataFrame([(0, 1, 2)], "query_id BIGINT, term INT, weight INT")
    assert len(found(search.exact(index.build(d), q))[0]) == 3
    padded = search.search(index.build(d), q, SearchConfig(pad_zero=True)).collect()
    assert len(padded) == 10 and sum(r["doc_id"] == 0 for r in padded) == 7


def test_pruned_pool_reranks_with_full_vectors(spark):
    docs, queries, d, q = corpus(spark)
    out = found(search.search(index.build(d, VectorPrune(alpha=0.8), VectorPrune(alpha=0.9)), q, SearchConfig(10, 60, prune=QueryPrune(alpha=0.7))))
    for qid, rows in out.items():
        for doc, score in rows:
            assert score == sum(w * docs[doc].get(t, 0) for t, w in queries[qid].items())


def test_window_layout_needs_no_exchange_after_the_join(spark):
    docs, queries, d, q = corpus(spark)
    postings = index.windowed(d, 7, layout=True)
    plan = search.accumulate(postings, q)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(window_id" in plan


def test_save_load_append(spark, tmp_path):
    docs, queries, d, q = corpus(spark)
    path = str(tmp_path / "ix")
    index.save(index.build(d.where("doc_id < 30"), window=10), path)
    index.append(spark, path, d.where("doc_id >= 30"), 10)
    assert found(search.exact(index.load(spark, path, 10), q, 10, 60)) == brute(docs, queries, 10)


def test_metrics(spark):
    res = spark.createDataFrame([(1, r, d) for r, d in ((1, 10), (2, 11), (3, 12))], "query_id BIGINT, rank INT, doc_id BIGINT")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (1, 12, 2)], "query_id BIGINT, doc_id BIGINT, relevance INT")
    from math import log2

    assert metrics.ndcg(res, qrels).first()[0] == round(2.5 / (3 + 1 / log2(3)), 6)
    assert metrics.mrr(res, qrels).first()[0] == 1.0 and metrics.success(res, qrels).first()[0] == 1.0
    assert metrics.recall(res, res).first()[0] == 1.0
    ideal = spark.createDataFrame([(1, 1, 12), (1, 2, 10)], "query_id BIGINT, rank INT, doc_id BIGINT")
    assert metrics.ndcg(ideal, qrels).first()[0] == 1.0
    assert metrics.evaluate(res, qrels).first()["recall"] is None
