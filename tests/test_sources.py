"""Files written and read back, distances, quantizers, streaming and the sweep."""

import numpy as np
import pytest

from impactrank import fixtures as fx
from impactrank.functions import distance, quantize
from impactrank.operators import index, search
from impactrank.plans import experiments
from impactrank.sources import csr, text
from impactrank.streaming.ingest import ingest

ROWS = [(0, [1, 70_000], [0.5, 3.5]), (1, [], []), (2, [3], [0.001]), (3, [0, 1, 2], [1.0, 2.0, 3.0])]


def test_csr_round_trip(spark, tmp_path):
    path = str(tmp_path / "m.csr")
    csr.write_csr(spark.createDataFrame(ROWS, "row_id BIGINT, indices ARRAY<INT>, weights ARRAY<FLOAT>"), path)
    assert csr.read_header(path) == (4, 70_001, 6)
    back = {r["row_id"]: (r["indices"], r["weights"]) for r in csr.read_csr(spark, path, elements_per_partition=2).collect()}
    assert back == {i: (x, [float(np.float32(v)) for v in w]) for i, x, w in ROWS}
    long = {(r["doc_id"], r["term"]): r["weight"] for r in csr.csr_to_vectors(csr.read_csr(spark, path)).collect()}
    assert long == {(0, 1): 21, (0, 70_000): 127, (2, 3): 0, (3, 0): 42, (3, 1): 85, (3, 2): 127}
    assert csr.read_csr(spark, path, limit_rows=2).count() == 2
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        csr.read_header(path)


def test_triplets(spark):
    out = csr.triplet_to_vectors(spark, [0, 2, 2, 3], [4, 5, 6], [1.0, 9.0, -1.0])
    assert sorted(map(tuple, out.collect())) == [(0, 4, 42), (0, 5, 127), (2, 6, 0)]


def test_text_formats(spark, tmp_path):
    q = tmp_path / "qrels"
    q.write_text("1\t0\ta\t1\n1\t0\ta\t2\n2 0 b 0\nbad line\n")
    assert sorted(map(tuple, text.read_qrels(spark, str(q)).collect())) == [("1", "0", "a", 2), ("2", "0", "b", 0)]
    p = tmp_path / "q.pisa"
    p.write_text("q1: x y x\nq2: z\n")
    assert sorted(map(tuple, text.read_pisa(spark, str(p)).collect())) == [("q1", "x", 2.0), ("q1", "y", 1.0), ("q2", "z", 1.0)]
    ranked = spark.createDataFrame([(0, 1, 7, 9), (0, 2, 5, 8), (1, 1, 3, 4)], "query_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    text.write_trec(ranked, str(tmp_path / "run"))
    back = text.read_trec(spark, str(tmp_path / "run")).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in back) == [("0", 1, "7", 9.0), ("0", 2, "5", 8.0), ("1", 1, "3", 4.0)]
    (tmp_path / "res").write_text("7,5\n3\n")
    assert sorted(map(tuple, text.read_results(spark, str(tmp_path / "res")).collect())) == [(0, 1, 7), (0, 2, 5), (1, 1, 3)]
    text.write_results(ranked, str(tmp_path / "lines"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["3", "7,5"]
    v = spark.createDataFrame([("a", "x", 1.5), ("a", "y", 0.0), ("b", "x", 2.0)], "doc_id STRING, term STRING, weight DOUBLE")
    text.write_jsonl(v, str(tmp_path / "j"))
    assert sorted(map(tuple, text.read_jsonl(spark, str(tmp_path / "j")).collect())) == [("a", "x", 1.5), ("b", "x", 2.0)]
    (tmp_path / "s.json").write_text('[{"exp_id": "e", "alpha": 0.5, "beta": 1.0, "k": 10}]')
    assert text.read_sweep(spark, str(tmp_path / "s.json")).first()["alpha"] == 0.5


def test_convert(spark):
    v = spark.createDataFrame([(0, 0, 10.0), (0, 1, 4.0), (0, 2, 1.0), (1, 1, 8.0), (1, 9, 5.0)], "doc_id BIGINT, term INT, weight DOUBLE")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal BIGINT, value STRING")
    ids = spark.createDataFrame([(0, "D0"), (1, "D1")], "ordinal BIGINT, value STRING")
    out = sorted(map(tuple, text.convert(v, names, ids, alpha=0.9, max_ratio=0.3, list_ratio=0.6).collect()))
    assert out == [("D0", "a", 10.0), ("D1", "b", 8.0)]
    assert text.conversion_stats(v, v.where("weight > 4")).first()["removed"] == 2


def test_ordinals(spark):
    ids = spark.createDataFrame([(7,), (3,), (7,), (11,)], "doc_id BIGINT")
    assert sorted(map(tuple, text.ordinal_ids(ids, "doc_id").collect())) == [(0, "3"), (1, "7"), (2, "11")]


def test_distances(spark):
    a = spark.createDataFrame([(1, 0, 3), (1, 1, 4)], "x BIGINT, term INT, weight INT")
    b = spark.createDataFrame([(2, 1, 4), (2, 2, 2)], "y BIGINT, term INT, weight INT")
    pairs = spark.createDataFrame([(1, 2)], "x BIGINT, y BIGINT")
    assert distance.dot(a, b, "x", "y").first()["dot"] == 16
    assert distance.manhattan(a, b, pairs, "x", "y").first()["manhattan"] == 5
    assert round(distance.euclidean(a, b, pairs, "x", "y").first()["euclidean"] ** 2, 9) == 13
    assert round(distance.cosine(a, b, "x", "y").first()["cosine"], 6) == round(16 / (5 * 20**0.5), 6)


def test_quantizers(spark):
    d = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.01, 1.5, 3.0, 9.0)], "v DOUBLE")
    assert [tuple(r) for r in d.select(quantize.positive(d.v), quantize.signed(d.v), quantize.unsigned_byte(d.v)).collect()] == [(0, -42, 0), (0, 0, 0), (0, 0, 1), (64, 64, 128), (127, 127, 255), (127, 127, 255)]


def test_streaming_ingest_equals_batch(spark, tmp_path):
    rows = [(i, f"alpha beta word{i % 3} gamma{i}") for i in range(9)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("doc_id BIGINT, text STRING").option("maxFilesPerTrigger", 1).parquet(src)
    ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp"), 4).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "ix/forward")).select("doc_id", "term", "weight")
    want = fx.text_impacts(spark.read.parquet(src), "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    loaded = index.load(spark, str(tmp_path / "ix"), 4)
    q = spark.createDataFrame([(0, "alpha", 5)], "query_id BIGINT, term STRING, weight INT")
    assert search.exact(loaded, q, 20, 20).count() == 9


def test_sweep(spark):
    docs = spark.createDataFrame([(i, t, (i * t) % 7 + 1) for i in range(12) for t in range(1, 6)], "doc_id BIGINT, term INT, weight INT")
    queries = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (1, 4, 5)], "query_id BIGINT, term INT, weight INT")
    qrels = spark.createDataFrame([(0, 3, 1), (1, 5, 1)], "query_id BIGINT, doc_id BIGINT, relevance INT")
    out = experiments.run(docs, queries, qrels, ("QD",), 3, 6).collect()
    assert len(out) == 3 and all(0 <= r["recall"] <= 1 for r in out)
    assert {r["phase"]: r["count"] for r in experiments.plan_counts(spark).collect()} == {"Q": 19, "D": 11, "P": 10, "QD": 3, "QP": 3}
