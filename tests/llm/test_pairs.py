"""Operators over pairs of rows, against brute force: Jaccard join, repeated passages, components, top-k."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from impactrank.llm import components, jaccard_join, suffix_dedup, topk_search
from impactrank.llm._spark import shared_dir
from impactrank.llm.suffix_array import equal_prefixes, suffix_array


def frame(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING" + "".join(f", {k} STRING" for k in extra))


def gram_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute_components(sets, percent):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size, copies in ((120, 40), (60, 20), (30, 12), (12, 8), (9, 5), (4, 4)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary[:30])
            texts.append(" ".join(w[: len(w) - rng.randint(0, 2)]))
    return texts + ["", None, "  ", "a", "A", "a b", "x y z", "X  Y\tz", "é É", texts[0], texts[0].upper()]


@pytest.mark.parametrize("n, percent, short", [(3, 90, None), (3, 90, 4), (5, 80, None)])
def test_join_equals_brute_force(spark, monkeypatch, n, percent, short):
    if short:  # long lists on small tables
        monkeypatch.setattr(jaccard_join, "SHORT", short)
        monkeypatch.setattr(jaccard_join, "ALIKE", 10)
    texts = near_copies(n)
    sets = gram_sets([t.replace("É", "Ā") if t else t for t in texts], n)  # only A-Z are lower-cased
    want = brute_components(sets, percent)
    out = {r["doc_id"]: r for r in jaccard_join.jaccard_components(frame(spark, texts, n="x", key="y"), n, percent).collect()}
    assert [out[i]["component_id"] for i in range(len(texts))] == want
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    copies = []
    for i in range(jaccard_join.ALIKE + 40):  # one list longer than ALIKE, all near its pivot
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        copies.append(" ".join(w))
    texts = copies + [t for t in near_copies(n) if t is None or t.isascii()]
    sets = gram_sets(texts, n)
    first = [min(j for j in range(len(sets)) if sets[j] == s) for s in sets]
    classes = sorted({i for i in first if sets[i]})
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(classes, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    out = jaccard_join.jaccard_links(frame(spark, texts), n, percent).collect()
    assert len(out) == len(want) > 1000 and {(r["a"], r["b"]): r["common"] for r in out} == want
    assert all(r["similarity"] == pytest.approx(len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]])) for r in out)


def test_join_edges(spark):
    df = frame(spark, ["a b c d", "a b c d"])
    again = jaccard_join.jaccard_components(df.unionByName(df)).collect()
    assert len(again) == 4 and {r["component_id"] for r in again} == {0}
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (5, None)], "doc_id BIGINT, text STRING")
    assert [(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(nulls).collect()] == [(5, 5)]


def test_join_of_very_long_texts(spark):
    rng = random.Random(41)
    words = [f"w{rng.randrange(20_000)}" for _ in range(60_000)]
    near = list(words)
    for k in range(0, 60_000, 200):
        near[k] = "other"
    far = list(words)
    for k in range(0, 60_000, 12):
        far[k] = "other"
    texts = [" ".join(x) for x in (words, near, far)] + ["w1 w2 w3", "  "]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    sets = gram_sets(texts, 3)
    assert [out[i] for i in range(5)] == [(len(s), c) for s, c in zip(sets, brute_components(sets, 90))] and out[1][1] == 0 and out[2][1] == 2


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(7)
    for n in (10, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.95)], rng.integers(0, 1 << 63, n // 20 + 1, dtype=np.uint64)]))
        x, y = jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b)
        size = min(len(x), len(y))
        bits = int.from_bytes(jaccard_join._fold(x, size) ^ jaccard_join._fold(y, size)).bit_count()
        assert bits <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100)] + [(300, k) for k in range(301, 330)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), shared_dir(spark)).collect()}
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)} | {i: 300 for i in range(300, 330)}


def test_suffix_array_and_prefix_groups():
    rng = np.random.default_rng(8)
    for n in [*range(1, 30), 100, 500]:
        for letters in (1, 2, 5):
            s = rng.integers(1, letters + 1, n)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:].tolist()))
    s = rng.integers(1, 3, 300)
    starts = np.arange(0, 290)
    g = equal_prefixes(s, starts, 8)
    for i, j in itertools.combinations(range(0, 290, 3), 2):
        assert (g[i] == g[j]) == (s[i : i + 8] == s[j : j + 8]).all()


def brute_removal(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                mark[i] += 1
                mark[i + length] -= 1
            seen.add(b[i : i + length])
        cut = np.cumsum(mark[:-1]) > 0
        spans = int((cut & ~np.append(False, cut[:-1])).sum()) if len(b) else 0
        out.append((len(b), int(cut.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [None, 2])
def test_removal_equals_brute_force(spark, monkeypatch, group):
    if group:  # split groups on small tables
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(6)]
    texts = []
    for _ in range(60):
        body = " ".join(word() for _ in range(rng.randint(5, 60)))
        if rng.random() < 0.6:
            p = rng.choice(passage)
            cut = rng.randrange(0, 60)
            p = p[cut : cut + rng.randint(30, 200)]
            body = body[: len(body) // 2] + p + body[len(body) // 2 :]
        texts.append(body)
    texts += ["", None, "ab" * 200, "ab" * 150, "z" * 99, "z" * 99, "z" * 100, texts[0], texts[0], passage[0] + passage[0], "The " * 400]
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts, n_bytes="x", ranges="y"), 100, digest=True).collect()}
    assert [(out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept_sha256"]) for i in range(len(texts))] == brute_removal(texts, 100)


def test_removal_outputs_and_edges(spark):
    df = frame(spark, ["x" * 30 + "abcdefghij" * 12, "abcdefghij" * 12 + "y" * 30])
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, 50).collect()}
    assert out[1]["spans"] and bytes(out[1]["kept"]) == b"y" * 30
    assert suffix_dedup.remove_repeats(df.where("false"), 50).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, 3)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 3)  # more than one block
    monkeypatch.setattr(topk_search, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(10)
    x = rng.normal(0, 0.2, (400, 16)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, [float(v) for v in x[i]], i) for i in range(400)]
    rows[3] = (3, None, 0)
    rows[50] = (50, [float("nan")] * 16, 0)
    rows[51] = (51, [None, *rows[51][1][1:]], 0)
    rows[52] = (52, [1.0, 2.0], 0)
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, score INT")
    got = {}
    for r in topk_search.top_k(df, df.where("vec_id % 50 = 0 OR vec_id = 52"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    live = [i for i in range(400) if i not in (3, 50, 51, 52)]
    for q in range(0, 400, 50):
        if q == 50:
            assert q not in got
            continue
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in live if i != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert 52 not in got
    assert topk_search.top_k(df.where("false"), df.where("false")).count() == 0


def test_removal_of_rows_with_one_id_and_very_long_texts(spark):
    rng = random.Random(31)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, long = prose(150), prose(300_000)
    rows = [(0, prose(200) + passage), (1, passage + prose(180)), (1, prose(330)), (2, long), (3, prose(50) + long[1000:260_000]), (4, "x"), (4, "x")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), 100).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in out) == [(0, 350, 0), (1, 330, 0), (1, 330, 150), (2, 300_000, 0), (3, 259_050, 259_000), (4, 1, 0), (4, 1, 0)]
    doubled = suffix_dedup.remove_repeats(spark.createDataFrame([(0, passage), (0, passage), (1, passage)], "doc_id BIGINT, text STRING"), 100).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in doubled) == [(0, 0), (0, 0), (1, 150)]


def brute_top(candidates, queries, k):
    """(query, rank, candidate, score) by whole numbers of any size."""
    whole = lambda v: None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256.0 * x)) for x in v]
    out = []
    for q, v in queries:
        if whole(v):
            best = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), c) for c, w in candidates if c != q and whole(w) and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best[:k])]
    return sorted(out)


def test_top_k_of_large_components_and_repeated_rows(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, 0.0]), (2, [5e6, 0.0]), (3, [-4e6, 7.5]), (4, [1e-3, -2.0]), (5, [9e15, 1.0]), (6, [9e15, 1.5]), (6, [9e15, 1.5]), (7, [0.0, 0.0]), (8, [])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, id INT, row INT")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i in (0, 4, 6, 7)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    held = lambda s: max(min(s, 2**63 - 1), -(2**63))
    want = [(q, r, c, held(s)) for q, r, c, s in brute_top(rows, [x for x in rows if x[0] in (0, 4, 6, 7)], 4)]
    got = topk_search.top_k(df, asked, 4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    small = topk_search.top_k(df.where("vec_id IN (1, 2)"), asked.where("vec_id = 0"), 5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in small) == [(1, 2, 983040000000000000), (2, 1, 393216000000000000)]


def test_order_of_whole_numbers():
    numbers = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**200, -(2**200), 2**200 + 1]
    assert sorted(numbers, key=topk_search.sortable) == sorted(numbers)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(0, 1, (3000, 32)).tolist())], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    read = spark.sparkContext.accumulator(0)
    exact = topk_search.exact_scores

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield from exact(iter([batch]))

    monkeypatch.setattr(topk_search, "exact_scores", counted)
    topk_search.top_k(df, df.where("vec_id < 3"), 5).collect()
    assert read.value < 600


def test_near_copies_meet_a_pivot_not_each_other(spark, monkeypatch):
    """The pairs whose sets are compared grow with the rows of a group, not with their square, and the group stays one."""
    rng = np.random.default_rng(11)
    base, size = [f"w{x}" for x in rng.integers(0, 10**6, 400)], 20
    texts = []
    for i in range(size):
        words = list(base)
        words[20 * i] = f"edit{i}"
        texts.append(" ".join(words))
    compared, confirmed = [], jaccard_join._Join.confirmed

    def counted(self, pairs, step):
        compared.append(pairs.count())
        return confirmed(self, pairs, step)

    monkeypatch.setattr(jaccard_join._Join, "confirmed", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    out = jaccard_join.jaccard_components(docs).collect()
    assert {r["component_id"] for r in out} == {0} and len(out) == size
    assert 0 < sum(compared) <= 4 * size < size * (size - 1) // 2


def test_connected_lists_make_no_further_rounds(spark, monkeypatch):
    """A long list goes on only as far as links leave more than ALIKE rows outside its largest component; these meet all its rows."""
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "ALIKE", 8)
    rng, texts = random.Random(23), []
    base = [f"w{x}" for x in range(300)]
    for i in range(40):  # all near one another
        words = list(base)
        for at in rng.sample(range(300), 1 + i % 3):
            words[at] = f"edit{i}_{at}"
        texts.append(" ".join(words))
    for i in range(5):  # rows that share much with all and link with none
        words = list(base)
        for at in range(i, 300, 15):
            words[at] = f"far{i}_{at}"
        texts.append(" ".join(words))
    names, write = [], jaccard_join.write_table

    def written(df, folder, name):
        names.append(name)
        return write(df, folder, name)

    monkeypatch.setattr(jaccard_join, "write_table", written)
    sets = gram_sets(texts, 5)
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, texts), 5, 80).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(sets, 80) and len(set(out.values())) == 6
    assert "star_0" in names and not any(x.startswith(("met_", "long_1")) for x in names)
