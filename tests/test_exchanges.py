"""What searches move: texts and blocks once, never postings by query and document."""

import random
import re

import pytest

from impactrank import fixtures as fx
from impactrank.operators import cluster, index, scan, search
from impactrank.operators.prune import VectorPrune
from impactrank.plans import blockmax


def tables(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{chr(97 + (d * k) % 7)}" for k in range(1, 9))) for d in range(40)], "doc_id BIGINT, text STRING")
    asked = spark.createDataFrame([(0, "wa wb"), (1, "wc wc wd")], "item_id BIGINT, text STRING")
    return fx.text_impacts(docs, "doc_id"), fx.text_impacts(asked, "item_id", out_id="query_id").persist()


def dealt(df):
    """Columns by which rows are dealt, one entry for each exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


def test_scores_of_documents_move_texts_only(spark):
    docs, queries = tables(spark)
    assert dealt(search.accumulate(index.build(docs, VectorPrune(alpha=0.9)).postings, queries)) == ["doc_id"]


def test_lists_of_some_terms(spark):
    docs, queries = tables(spark)
    rules = VectorPrune(alpha=0.9), VectorPrune(alpha=0.6, fixed_top=9)
    rows = lambda ix: sorted(map(tuple, ix.postings.select("term", "doc_id", "weight").collect()))
    terms = {r["term"] for r in queries.collect()}
    assert rows(index.build(docs, *rules, terms=queries)) == [r for r in rows(index.build(docs, *rules)) if r[0] in terms] != []


def test_bounds_and_scores_stay_in_their_blocks(spark):
    docs, queries = tables(spark)
    ix = index.build(docs)
    by_block = blockmax.by_block(ix, queries, 4).persist()
    by_block.count()
    out = blockmax.blockmax_search(ix, queries, 3, 4, rows=by_block)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, search.search(ix, queries, search.SearchConfig(3, 3, rerank=False)).collect()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not any("doc_id" in x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("InMemoryRelation")[0]))


def clustered(spark, weight, word):
    """Documents with many ties, some in two clusters or none, and the brute-force best of all that share a term."""
    rng = random.Random(5)
    docs = {d: {word(t): weight * rng.randint(0, 2) for t in rng.sample(range(12), 4)} for d in rng.sample(range(10_000), 300)}
    members = [(c, d) for d in docs for c in rng.choice(((1,), (2,), (3,), (1, 3), (2, 2), ()))]
    queries = {q: {word(t): weight * rng.randint(1, 3) for t in rng.sample(range(12), 3)} for q in range(9)}
    kind = type(word(0)).__name__.replace("str", "string")
    make = lambda x, c: spark.createDataFrame([(i, t, w) for i, v in x.items() for t, w in v.items()], f"{c} BIGINT, term {kind}, weight INT")
    want = set()
    for q, qv in queries.items():
        score = {d: sum(w * dv.get(t, 0) for t, w in qv.items()) * sum(e == d for _, e in members) for d, dv in docs.items()}
        want |= {(q, n, d, x) for n, (x, d) in enumerate(sorted(((x, d) for d, x in score.items() if x > 0), key=lambda p: (-p[0], p[1]))[:7], 1)}
    return make(docs, "doc_id"), spark.createDataFrame(members, "cluster_id INT, doc_id BIGINT"), make(queries, "query_id"), want


@pytest.mark.parametrize(("weight", "word"), [(1, int), (3000, str), (500_000_000, str)])
def test_clusters_are_scanned_where_they_are(spark, monkeypatch, weight, word):
    vectors, members, queries, want = clustered(spark, weight, word)
    monkeypatch.setattr(scan, "BLOCK_ITEMS", 20)  # several blocks, and matrices of a few rows
    monkeypatch.setattr(scan, "CHUNK_CELLS", 90)
    # Whole summaries and queries and a large factor admit every cluster with a common term.
    out = search.cluster_search(vectors, members, cluster.summary(vectors, members), queries, 7, 12, 1e9)
    assert set(map(tuple, out.collect())) == want
    rows = scan.by_document(vectors, members)
    asked = queries.withColumnRenamed("weight", "qw")
    found = scan.best_in_clusters(rows, asked, queries.select("query_id").distinct().crossJoin(members.select("cluster_id").distinct()), 7)
    assert set(dealt(found)) == {"doc_id"}  # documents and members, never pairs with a query


def test_blocks_are_made_from_texts_dealt_once(spark):
    texts = spark.createDataFrame([(d, " ".join(f"w{chr(97 + (d * k) % 7)}" for k in range(1, 9))) for d in range(40)], "doc_id BIGINT, text STRING")
    docs, queries = tables(spark)
    rows = fx.text_impacts(texts, "doc_id", terms=queries, block=4)
    assert dealt(rows) == ["block_id", "term"]  # texts once; the other are the distinct terms, which are broadcast
    names = ["term", "doc_id", "weight", "block_id"]
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(map(tuple, blockmax.by_block(index.build(docs), queries, 4).select(names).collect())) != []


def test_texts_stay_where_items_are_looked_for(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "see the red old house now"), (1, "red old\nhouse the red old house nowhere"), (2, "old red house"), (3, None)], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(0, "he red old house no"), (1, "the red old"), (2, "d old\nhouse t"), (3, "red house"), (4, "old")], "item_id BIGINT, text STRING")
    labels = spark.createDataFrame([(0, 1)], "doc_id BIGINT, quality INT")
    want = [(0, 0, 2), (0, 1, 1), (1, 0, 2), (1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 0, 2), (4, 1, 1), (4, 2, 1)]
    few = fx.containment_qrels(docs, items, labels)
    assert re.search(r"BroadcastHashJoin \[word#\d+\].*Contains\(body#\d+, item#\d+\)", few._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(fx, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, fx.containment_qrels(docs, items, labels).collect())) == want


def test_recall_moves_texts_only(spark):
    docs, queries = tables(spark)
    pruned = index.build(docs, VectorPrune(alpha=0.9), VectorPrune(alpha=0.9), terms=queries)
    first = [dealt(search.accumulate(ix.postings, queries)) for ix in (pruned, index.build(docs))]
    assert not any("query_id" in x or "window_id" in x for plan in first for x in plan)  # what recall compares, before its ranking
