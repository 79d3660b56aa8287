"""Level tables, cluster and block-maximum search, saved indexes with streams, sinks and the one-call runner."""

import json
import random

import pytest

from impactrank import fixtures as fx
from impactrank.functions import distance, vectors
from impactrank.operators import analyze, cluster, index, prune, search
from impactrank.operators.prune import VectorPrune
from impactrank.plans import blockmax, experiments
from impactrank.sources import csr, text
from impactrank.streaming.ingest import ingest


def postings(spark, seed=1, docs=90, terms=7):
    rng = random.Random(seed)
    rows = [(d, t, rng.randint(0, 6)) for d in range(docs) for t in range(terms) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "doc_id BIGINT, term INT, weight INT"), rows


def as_set(df):
    return sorted((r["doc_id"], r["term"], r["weight"]) for r in df.collect())


@pytest.mark.parametrize("span", [4096, 5])
def test_levels_equal_ranking_each_list(spark, monkeypatch, span):
    monkeypatch.setattr(prune, "RANK_SPAN", span)
    df, _ = postings(spark)
    for p in (VectorPrune(0.6, 0.2, 20, 0.3), VectorPrune(0.9), VectorPrune(max_ratio=0.5), VectorPrune(fixed_top=11), VectorPrune(longest=0.5), VectorPrune(alpha=0.01, longest=0.4)):
        assert as_set(prune.prune_lists(df, p)) == as_set(prune.prune_lists(df, p, integers=False))
    named = df.withColumn("doc_id", df.doc_id.cast("string"))
    assert as_set(prune.list_mass_exclusive(named, 0.5)) == as_set(prune.mass_exclusive(named, "term", "doc_id", 0.5))


def brute(rows, asked, k):
    out = []
    for q, terms in asked.items():
        score = {}
        for d, t, w in rows:
            score[d] = score.get(d, 0) + w * terms.get(t, 0)
        best = sorted(((-s, d) for d, s in score.items() if s > 0))[:k]
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    return sorted(out)


def test_cluster_and_block_search(spark):
    df, rows = postings(spark, 2)
    asked = {0: {0: 3, 1: 1}, 1: {2: 5, 6: 1, 4: 2}}
    queries = spark.createDataFrame([(q, t, w) for q, x in asked.items() for t, w in x.items()], "query_id BIGINT, term INT, weight INT")
    members = spark.createDataFrame([(d % 6, d) for d in range(90)], "cluster_id INT, doc_id BIGINT")
    got = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    whole = cluster.summary(df, members)
    assert got(search.cluster_search(df, members, whole, queries, 5, 10, 1.0, 1)) == brute(rows, asked, 5)
    fewer = got(search.cluster_search(df, members, cluster.summary_mass(df, members, 0.5), queries, 5, 1, 0.1, 1))
    assert fewer and all(s == sum(w * asked[q].get(t, 0) for d2, t, w in rows if d2 == d) for q, _, d, s in fewer)
    ix = index.build(df)
    assert got(blockmax.blockmax_search(ix, queries, 5)) == brute(rows, asked, 5)
    sweep = blockmax.blockmax_sweep(ix, queries, [(1.0, 1.0, 5), (1.0, 0.5, 3)]).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in sweep if r["beta"] == 1.0) == brute(rows, asked, 5)
    half = {0: {0: 3}, 1: {2: 5, 4: 2}}
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in sweep if r["beta"] == 0.5) == brute(rows, half, 3)
    assert search.mean_postings_touched(ix, queries).first()["queries"] == 2


def test_saved_index_takes_appends_and_streams(spark, tmp_path):
    path = str(tmp_path / "ix")
    word = lambda ids: spark.createDataFrame([(i, f"alpha beta w{i % 3}") for i in ids], "doc_id BIGINT, text STRING")
    first = fx.text_impacts(word(range(6)), "doc_id")
    index.save(index.build(first, window=4), path)
    index.append(spark, path, fx.text_impacts(word(range(6, 8)), "doc_id"), 4)
    word(range(8, 11)).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("doc_id BIGINT, text STRING").parquet(str(tmp_path / "src"))
    ingest(stream, path, str(tmp_path / "cp"), 4).awaitTermination()
    loaded = index.load(spark, path, 4)
    want = fx.text_impacts(word(range(11)), "doc_id")
    assert as_set(loaded.forward) == as_set(want) == as_set(loaded.postings)
    q = spark.createDataFrame([(0, "alpha", 5)], "query_id BIGINT, term STRING, weight INT")
    assert search.exact(loaded, q, 20, 20).count() == 11
    changed = spark.createDataFrame([(3, "new", 9)], "doc_id BIGINT, term STRING, weight INT")
    held = as_set(index.update_vectors(want.select("doc_id", "term", "weight"), changed))
    assert [x for x in held if x[0] == 3] == [(3, "new", 9)] and len({x[0] for x in held}) == 11


def test_judgements_of_short_items(spark):
    items = spark.createDataFrame([(0, "two three four"), (1, "a b"), (2, "ree fou"), (3, "one two three four five six seven"), (4, None), (5, "nowhere at all here now")], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame([(0, "one two three four five six seven eight"), (1, "xa bx"), (2, None), (3, "threefour")], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(0, 1)], "doc_id BIGINT, quality INT")
    assert sorted(map(tuple, fx.containment_qrels(docs, items, labels).collect())) == [(0, 0, 2), (1, 1, 1), (2, 0, 2), (3, 0, 2)]


def test_order_statistics_and_numbering(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(analyze, "RANK_PARTS", 8)
    monkeypatch.setattr(text, "ORDINAL_PARTS", 4)
    rng = random.Random(3)
    for n in (1, 2, 7, 500):
        v = sorted(round(rng.expovariate(1), 2) for _ in range(n))
        r = analyze.latency_stats(spark.createDataFrame([(x,) for x in rng.sample(v, n)], "x DOUBLE"), "x").first()
        assert [r["median"], r["p90"], r["p95"], r["p99"], r["n"], r["min"], r["max"]] == [*(v[min(int(n * p), n - 1)] for p in (0.5, 0.9, 0.95, 0.99)), n, v[0], v[-1]]
    assert analyze.latency_stats(spark.createDataFrame([], "x DOUBLE"), "x").first()["n"] is None
    names = [f"id{rng.randrange(10**6)}" for _ in range(300)]
    got = text.ordinal_ids(spark.createDataFrame([(x,) for x in names * 2], "k STRING"), "k").collect()
    assert sorted(map(tuple, got)) == list(enumerate(sorted(set(names))))
    (tmp_path / "lines").write_text("\n".join(f"line {i}" for i in range(1000)))
    assert sorted(map(tuple, text.read_lines(spark, str(tmp_path / "lines")).collect())) == [(i, f"line {i}") for i in range(1000)]


def test_scalar_helpers(spark):
    v = spark.createDataFrame([(1, 0, 3), (1, 2, -4), (2, 1, 5)], "doc_id BIGINT, term INT, weight INT")
    arrays = vectors.as_arrays(v, "doc_id")
    assert {r[0]: r[1] for r in arrays.select("doc_id", vectors.value_of(arrays.terms, arrays.weights, arrays.doc_id * 0 + 2)).collect()} == {1: -4, 2: 0}
    assert {r[0]: r[1] for r in vectors.total(v, "doc_id").collect()} == {1: -1, 2: 5}
    assert {r[0]: r[1] for r in vectors.values_of_term(v, "doc_id", 1).collect()} == {1: 0, 2: 5}
    assert [(r["term"], r["place"]) for r in vectors.impact_order(v.where("doc_id = 1"), "doc_id", budget=1).collect()] == [(0, 1)]
    d = spark.createDataFrame([([0, 1, 9], [1, 2, 3], [0.75, 0.75])], "t ARRAY<INT>, w ARRAY<INT>, x ARRAY<DOUBLE>")
    assert d.select(distance.sparse_dense_dot(d.t, d.w, d.x), distance.sparse_float_dot_int32(d.t, d.w, d.x)).first()[:] == (2.25, 1)


def test_sinks_grids_and_run_config(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "exp_id STRING, recall DOUBLE")
    for _ in range(2):
        text.write_experiments(rows, str(tmp_path / "exp"))
    assert text.read_experiments(spark, str(tmp_path / "exp")).count() == 4
    text.write_sweep(rows, str(tmp_path / "sweep"))
    assert json.loads(spark.read.text(str(tmp_path / "sweep")).first()[0]) == [{"exp_id": "a", "recall": 0.5}, {"exp_id": "b", "recall": 0.25}]
    assert len(list(experiments.grid())) == 46 and len(list(experiments.block_grid())) == 80 and len(list(experiments.cluster_grid())) == 79
    assert len({x[1] for x in [*experiments.grid(), *experiments.block_grid(), *experiments.cluster_grid()]}) == 205
    schema = "row_id BIGINT, indices ARRAY<INT>, weights ARRAY<FLOAT>"
    csr.write_csr(spark.createDataFrame([(i, [i % 3, 5], [1.0 + i / 10, 0.5]) for i in range(9)], schema), str(tmp_path / "docs.csr"))
    csr.write_csr(spark.createDataFrame([(0, [0], [1.0]), (1, [5], [2.0])], schema), str(tmp_path / "queries.csr"))
    (tmp_path / "truth").write_text("6,3,0\n0,1,2\n")
    (tmp_path / "qrels").write_text("0\t0\t3\t1\n1\t0\t0\t2\n")
    base = {"doc_file": str(tmp_path / "docs.csr"), "query_file": str(tmp_path / "queries.csr"), "k": 3, "kprime": 5, "ground_truth_file": str(tmp_path / "truth"), "qrels_file": str(tmp_path / "qrels")}
    r = experiments.run_config(spark, base | {"output": str(tmp_path / "out"), "per_query_output": str(tmp_path / "lat")}).first()
    assert (r["queries"], r["hits"], r["recall"], r["mrr"], r["success"]) == (2, 6, 1.0, 0.75, 1.0)
    assert sorted(x[0] for x in spark.read.text(str(tmp_path / "out")).collect()) == ["0,1,2", "6,3,0"]
    assert spark.read.option("header", True).csv(str(tmp_path / "lat")).columns == ["query_idx", "latency_ms"]
    with pytest.raises(ValueError):
        experiments.run_config(spark, {"nothing": 1})
