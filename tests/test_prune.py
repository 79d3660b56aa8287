"""Hand tables for each pruning rule, and properties against a loop model."""

import random

import numpy as np
import pytest

from impactrank.operators import prune as P
from impactrank.operators.prune import QueryPrune, VectorPrune


def vec(spark, weights, id_col="doc_id"):
    return spark.createDataFrame([(1, i + 1, w) for i, w in enumerate(weights)], f"{id_col} BIGINT, term INT, weight INT")


def kept(df):
    return sorted(r["term"] for r in df.collect())


def test_exclusive_mass_may_keep_nothing_and_inclusive_keeps_one(spark):
    d = vec(spark, [100, 10])
    assert kept(P.mass_exclusive(d, "doc_id", "term", 0.5)) == []
    assert kept(P.mass_inclusive(d, "doc_id", "term", 0.5)) == [1]


def test_tie_at_cutoff(spark):
    d = vec(spark, [5, 5, 5])
    assert kept(P.mass_exclusive(d, "doc_id", "term", 0.7)) == [1, 2]
    assert kept(P.mass_inclusive(d, "doc_id", "term", 0.7)) == [1, 2, 3]
    assert kept(P.mass_inclusive_int8(d, "doc_id", "term", 0.7)) == [1, 2]


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_mass_edges(spark, alpha):
    d = vec(spark, [5, 0, 3])
    for f in (P.mass_exclusive, P.mass_inclusive, P.mass_inclusive_int8):
        assert kept(f(d, "doc_id", "term", alpha)) == [1, 2, 3]


def test_ratio_rules(spark):
    d = vec(spark, [10, 5, 1])
    assert kept(P.doc_ratio(d, "doc_id", 0.5)) == [1]
    assert kept(P.query_ratio(d, "doc_id", 0.5)) == [1, 2]
    assert kept(P.plain_ratio(d, "doc_id", 0.5)) == [1, 2]
    edge = vec(spark, [10, 7])
    assert kept(P.doc_ratio(edge, "doc_id", 0.7)) == [1]
    assert kept(P.list_ratio(edge.withColumnRenamed("term", "x").withColumnRenamed("doc_id", "term").withColumnRenamed("x", "doc_id"), 0.7).selectExpr("doc_id AS term")) == [1, 2]
    assert kept(P.query_ratio(edge, "doc_id", 0.7)) == [1, 2]


def test_ratio_edges(spark):
    d = vec(spark, [10, 0, 4])
    assert kept(P.doc_ratio(d, "doc_id", 0.0)) == [1, 3]
    assert kept(P.doc_ratio(d, "doc_id", 1.0)) == [1, 2, 3]
    assert kept(P.query_ratio(d, "doc_id", 1.0)) == [1]
    assert kept(P.plain_ratio(d, "doc_id", None)) == [1, 2, 3]


def test_fixed_top(spark):
    d = vec(spark, [3, -9, 5])
    assert kept(P.fixed_top(d, "doc_id", "term", 2)) == [2, 3]
    assert kept(P.fixed_top(d, "doc_id", "term", 2, signed=True)) == [1, 3]
    assert kept(P.fixed_top(d, "doc_id", "term", 9)) == [1, 2, 3]


def test_longest_lists(spark):
    rows = [(d, t, 1) for t, n in ((1, 4), (2, 3), (3, 2), (4, 1)) for d in range(n)]
    p = spark.createDataFrame(rows, "doc_id BIGINT, term INT, weight INT")
    assert sorted({r["term"] for r in P.drop_longest_lists(p, 0.5).collect()}) == [3, 4]
    tied = spark.createDataFrame([(d, t, 1) for t in range(6) for d in range(3)], "doc_id BIGINT, term INT, weight INT")
    assert sorted(r["term"] for r in P.longest_lists(tied, 0.5).collect()) == [0, 1, 2]
    assert sorted({r["term"] for r in P.drop_longest_lists(p, 0.5, all_terms=8).collect()}) == []


def test_int8_wrap(spark):
    assert kept(P.mass_inclusive_int8(vec(spark, [100, 60, 50, 10]), "doc_id", "term", 0.5)) == [1]


def loop_exclusive(items, alpha):
    total, run, out = np.float32(sum(w for _, w in items)), np.float32(0), []
    for k, w in sorted(items, key=lambda x: (-x[1], x[0])):
        run += np.float32(w)
        if run > np.float32(alpha) * total:
            break
        out.append(k)
    return sorted(out)


def test_list_levels_equal_loop_model(spark):
    rng = random.Random(3)
    rows = [(d, t, rng.choice([0, 0, 1, 2, 3, 5, 127])) for t in range(60) for d in range(rng.randint(1, 30))]
    p = spark.createDataFrame(rows, "doc_id BIGINT, term INT, weight INT")
    for alpha in (0.1, 0.5, 0.9):
        got = {}
        for r in P.list_mass_exclusive(p, alpha).collect():
            got.setdefault(r["term"], []).append(r["doc_id"])
        for t in range(60):
            want = loop_exclusive([(d, w) for d, x, w in rows if x == t], alpha)
            assert sorted(got.get(t, [])) == want, (t, alpha)
        again = sorted((r["term"], r["doc_id"]) for r in P.mass_exclusive(p, "term", "doc_id", alpha).collect())
        assert again == sorted((t, d) for t, ds in got.items() for d in ds)


def test_query_composition(spark):
    q = vec(spark, [10, 8, 5, 1], "query_id")
    terms = spark.createDataFrame([(1,), (2,), (3,)], "term INT")
    assert kept(P.prune_queries(q, QueryPrune(fixed_top=2), terms)) == [1, 2]
    assert kept(P.prune_queries(q, QueryPrune(max_ratio=0.5, fixed_top=1), terms)) == [1, 2, 3]
    assert kept(P.prune_queries(q, QueryPrune(max_ratio=0.4, fixed_top=2, compose="all", scope="all"), terms)) == [1, 2]


def test_pipeline_monotone(spark):
    d = vec(spark, [9, 7, 5, 3, 1])
    sizes = [P.prune_docs(d, VectorPrune(alpha=a)).count() for a in (0.2, 0.5, 0.8, 0.95)]
    assert sizes == sorted(sizes)
    assert set(kept(P.mass_exclusive(d, "doc_id", "term", 0.6))) <= set(kept(P.mass_inclusive(d, "doc_id", "term", 0.6)))


def test_audit(spark):
    d = vec(spark, [9, 7, 5])
    out = {r["term"]: (r["pruned_count"], r["posting_list_length"]) for r in P.audit(d, P.fixed_top(d, "doc_id", "term", 1), d).collect()}
    assert out == {2: (1, 1), 3: (1, 1)}
