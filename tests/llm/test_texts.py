"""Operators that look at one text at a time: language, quality, token counts, items, packing."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from impactrank.llm import decontaminate, langid, packing, quality, token_counts  # noqa: E402
from impactrank.llm._text import flat, pieces  # noqa: E402
from impactrank.llm._tokenizers import PieceCounter, WordTokenizer  # noqa: E402

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["it's don't'll we're 'S !!'s ''t 'tis a's't", "", "  ", "É ß Ŀ İ Ÿ straße ×÷ª²½x9 12a", "日本 text", "a\x00b", "<|endoftext|> hi", "x▁y  z", "a" * 300, "<s>\n\n\t z", "ﬁ ① ⅷ", "'re", "don", "'", None, "à la carte"]


def frame(spark, texts, **extra):
    rows = [(i, t, *[v for v in extra.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING" + "".join(f", {k} STRING" for k in extra))


def test_tokenizers_equal_their_libraries():
    w, p = WordTokenizer(Path(WORDS).read_text()), PieceCounter(Path(PIECES).read_bytes())
    rng = np.random.default_rng(1)
    texts = ODD + ["".join(rng.choice(list("abcé' .,!9TH\n"), 60)) for _ in range(200)] + ["long word " * 3000]
    data, off = flat(pa.array(texts))
    ids, counts = w.encode(data, off)
    ends = np.cumsum(counts)
    for t, e, k in zip(texts, ends, counts):
        assert ids[e - k : e].tolist() == w.library.encode(t or "", add_special_tokens=False).ids, t
    stop, total, row = p.prefix_totals(data, off)
    got = np.zeros(len(texts), int)
    got[row] = total
    assert got.tolist() == [len(p.library.encode(t or "")) for t in texts]


def test_prefix_table_answers_every_prefix():
    model = Path(PIECES).read_bytes()
    lib = token_counts.counter(model).library
    for t in ["", " ", "a  b  cde fgh", "déjà vu  \n z", "x▁y"]:
        table = token_counts.PrefixTable(t, model)
        want = [len(lib.encode(t[:p])) for p in range(len(t) + 1)]
        assert table.count == want and table.tokens() == want[-1]
        for budget in range(max(want) + 1):
            assert table.longest_within(budget) == max(p for p, c in enumerate(want) if c <= budget)


def test_stored_prefixes_answer_every_prefix(spark):
    lib = token_counts.counter(Path(PIECES).read_bytes()).library
    texts = ["QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 4, "日本語の文章には空白がない" * 3, "one two  three ", "x▁y", None, ""]
    for r in token_counts.prefix_totals(frame(spark, texts), PIECES, limit=9, keep_prefixes=True).collect():
        t = texts[r["doc_id"]] or ""
        ends = [len(t[:p].encode()) for p in range(len(t) + 1)]
        want = [len(lib.encode(t[:p])) for p in range(len(t) + 1)]
        table = r["prefix_end"], r["prefix_tokens"]
        assert [token_counts.tokens_at(*table, e) for e in ends] == want and r["n_tokens"] == want[-1]
        assert all(token_counts.fits(*table, b) == max(e for e, c in zip(ends, want) if c <= b) for b in range(max(want) + 2))


def test_token_counts(spark):
    df = frame(spark, ["one two three", None, "", "w " * 5000], n_tokens="x", over_limit="y")
    df = df.unionByName(df.where("doc_id = 0"))
    out = token_counts.prefix_totals(df, PIECES, limit=4096, keep_prefixes=True).collect()
    lib = token_counts.counter(Path(PIECES).read_bytes()).library
    assert len(out) == 5 and sum(r["doc_id"] == 0 for r in out) == 2
    for r in out:
        t = ["one two three", "", "", "w " * 5000][r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t), len(lib.encode(t))) and r["over_limit"] == (r["n_tokens"] > 4096)
        if r["prefix_end"]:
            end = token_counts.fits(r["prefix_end"], r["prefix_tokens"], 2)
            assert len(lib.encode(t[:end])) <= 2
    assert token_counts.prefix_totals(df.where("false"), PIECES, limit=1).count() == 0


def test_prefix_program_on_odd_texts_and_truncation(spark):
    rng = np.random.default_rng(30)
    counter = token_counts.counter(Path(PIECES).read_bytes())
    signs = [*"aÀéß日本語한국어▁x\t\nz👍🏽ﬁ½　'’012", " ", "  ", "<s>", "\0", "xyz", "qu"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 14))) for _ in range(250)]
    whole = [[len(x) for x in counter.library.encode([t[:p] for p in range(1, len(t) + 1)])] for t in texts]
    assert [token_counts.PrefixTable(t, Path(PIECES).read_bytes()).count[1:] for t in texts] == whole
    long = "".join(rng.choice(list("abcdefgh"), 30_000))  # one stretch without a space
    out = {r["doc_id"]: r for r in token_counts.prefix_totals(frame(spark, [*texts, long], cut_bytes="x"), PIECES, limit=4).collect()}
    for i, (t, want) in enumerate(zip(texts, whole)):
        fit = max([0, *(p + 1 for p, c in enumerate(want) if c <= 4)])
        assert (out[i]["n_tokens"], out[i]["cut_bytes"], out[i]["cut_tokens"]) == (want[-1], len(t[:fit].encode()), want[fit - 1] if fit else 0)
    cut = out[len(texts)]["cut_bytes"]
    assert out[len(texts)]["n_tokens"] == len(counter.library.encode(long)) and len(counter.library.encode(long[:cut])) <= 4 < len(counter.library.encode(long[: cut + 1]))


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(5), [1, 64, 65, 200, 7])
    emit = -rng.exponential(3, (len(rows), 3)).astype(np.float32)
    path = langid.viterbi(emit, rows, 5.0)
    for r in range(5):
        e, mine = emit[rows == r], path[rows == r]
        v = e[0].astype(float)
        for t in range(1, len(e)):
            v = np.maximum(v, v.max() - 5.0) + e[t]
        assert abs(e[np.arange(len(e)), mine].sum() - 5.0 * (mine[1:] != mine[:-1]).sum() - v.max()) < 1e-2


EN = "the quick brown fox jumps over the lazy dog and then the other thing with which they were working "
FR = "les élèves français étaient très heureux de cette leçon où ils avaient été dans la forêt près du château "
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом они пошли домой "


def test_language(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru"), (None, "en"), (EN, None)] * 8)], "doc_id BIGINT, text STRING, lang STRING")
    model = langid.fit(train)
    df = frame(spark, [EN, FR, RU, None, "", "123 !?", EN * 3 + FR * 2 + RU, EN * 2000, "日本語"], lang="zz", score="q")
    out = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [out[i]["lang_pred"] for i in range(8)] == ["en", "fr", "ru", "und", "und", "und", "en", "en"]
    assert out[3]["score"] == 0 and 0 < out[6]["score"] < 1 and out[8]["lang_pred"] in ("en", "fr", "ru")
    assert [s["lang"] for s in out[6]["spans"]] == ["en", "fr", "ru"]
    none = langid.fit(train.where("false"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0


def test_language_of_repeated_rows_and_every_word_by_brute_force(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru")] * 8)], "doc_id BIGINT, text STRING, lang STRING")
    model = langid.fit(train)
    texts = [EN + FR, RU + EN, FR * 2 + "42 " + EN, "the леса forêt", EN]
    df = frame(spark, texts)
    out = langid.identify(df.unionByName(df), model).collect()
    assert len(out) == 10
    for r in out:
        data, off = flat(pa.array([texts[r["doc_id"]]]))
        at, end, row, script, low = langid.words(data, off)
        e = langid.emissions(model, at, end, script, low)
        v, back = e[0].astype(float), []
        for x in e[1:]:
            jump = v.max() - model.switch > v
            back.append(np.where(jump, v.argmax(), np.arange(len(v))))
            v = np.maximum(v, v.max() - model.switch) + x
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        mass = np.bincount(path[::-1], weights=end - at, minlength=len(model.languages))
        assert (r["lang_pred"], round(r["score"], 9)) == (model.languages[int(mass.argmax())], round(mass.max() / mass.sum(), 9))


def test_quality_forward_equals_plain_loops():
    rng = np.random.default_rng(12)
    net = quality.train([bytes(rng.integers(97, 110, 60).tolist()) for _ in range(40)], np.arange(40) % 2, epochs=1)
    texts = [b"", b"x", bytes(range(40, 90)), bytes(rng.integers(0, 256, 900).tolist()), b"ab" * 300]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for t, got in zip(texts, quality.forward(net, data, off)):
        positions = max(1, -(-max(len(t) - quality.WIDTH, 0) // quality.STRIDE) + 1)
        r = []
        for p in range(positions):
            codes = [t[i] if i < len(t) else 256 for i in range(p * quality.STRIDE, p * quality.STRIDE + quality.WIDTH)]
            r.append(np.concatenate([net.embed[c] for c in codes]) @ net.filters + net.bias)
        chunks, begin = [], 0
        while True:
            chunks.append(np.maximum(np.max(r[begin : begin + quality.CHUNK], axis=0), 0))
            if begin + quality.CHUNK >= positions:
                break
            begin += quality.HOP
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)]) @ net.out + net.out_bias
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_of_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, [EN, "BAD!! " * 30, None, ""])
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 1)], "doc_id BIGINT, quality INT")
    net = quality.fit(docs.unionByName(docs), labels)
    out = quality.score(docs.unionByName(docs), net).collect()
    assert len(out) == 8 and len({(r["doc_id"], r["score"]) for r in out}) == 4
    assert quality.score(docs.where("false"), net).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs.where("false"), labels)).collect()} == {0.5}


def test_quality_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(EN.split(), 40))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choice(EN.split(), 40))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(360)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4] + [(1, None)], "doc_id BIGINT, quality INT")
    net = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, net).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert np.mean([out[r[0]]["predicted"] == r[2] for r in held]) > 0.95
    edge = quality.score(frame(spark, [None, "", "x", EN * 3000], score="z"), net).collect()
    assert len(edge) == 4 and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["score"] for r in quality.score(frame(spark, ["a"]), quality.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_every_byte_is_under_a_filter():
    for n in list(range(0, 40)) + [300, 301, 1000]:
        positions, first, begin, end, doc = quality.layout(np.array([0, n]))
        covered = np.zeros(n + 16, bool)
        for a, b in zip(begin, end):
            for p in range(a, b):
                covered[p * quality.STRIDE : p * quality.STRIDE + quality.WIDTH] = True
        assert covered[:n].all() and end.max() == positions[0]


def test_edit_distance_equals_dynamic_program():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (bytes(rng.integers(97, 100, rng.integers(1, 12)).tolist()) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0] = range(len(a) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert decontaminate.edit_distance(a, b)[0] == d[-1].min()


def test_items_are_found_up_to_edits(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(900)]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [words(30) for _ in range(30)] + ["too short", None]
    edited = [" ".join(w if k % 12 else "other" for k, w in enumerate(t.split())) for t in items[:30]]
    texts = [f"{words(50)} {t.upper()}!! {words(20)}" for t in items[:30]] + [f"{words(9)}, {t} {words(60)}" for t in edited] + [words(400) for _ in range(30)] + [None, "", "too short", words(20_000) + " " + items[3]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    out = {r["doc_id"]: r for r in decontaminate.find_items(frame(spark, texts, hits="x"), bench).collect()}
    assert all(out[i]["item_ids"] == [i] and out[i]["similarity"] == 1.0 for i in range(30))
    assert np.mean([out[30 + i]["item_ids"] == [i] for i in range(30)]) >= 0.95
    assert not any(out[i]["contaminated"] for i in range(60, 93)) and out[93]["item_ids"] == [3]
    h = out[2]["hits"][0]
    assert texts[2].encode()[h["start"] : h["end"]].decode().lower() == items[2]
    assert not any(r["contaminated"] for r in decontaminate.find_items(frame(spark, texts[:3]), bench.where("false")).collect())


def edited(rng, text, share, even):
    """ASCII text with as many edits as the share allows, evenly spaced or anywhere."""
    t, n = list(text), int(share * len(text))
    for p in sorted((int((i + 0.5) * len(t) / n) for i in range(n)) if even else rng.choice(len(t), n, replace=False), reverse=True):
        kind = int(rng.integers(0, 3))
        t[p : p + 1] = [[str(rng.choice(list("bdghjk")))], [t[p], str(rng.choice(list("bdghjk")))], []][kind]
    return "".join(t)


@pytest.mark.parametrize("share", [0.2, 0.1, 0.03])
def test_items_at_the_allowed_edits_equal_brute_force(share):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 7))) for _ in range(60)]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [words(n) for n in list(range(5, 60, 2)) * 2]
    texts = [f"{words(8)} {edited(rng, t, share, even)} {words(8)}" for t in items for even in (True, False)]
    index = decontaminate.build_items(list(range(len(items))), items, share)
    text, bounds, _ = decontaminate.normal(*flat(pa.array(texts)))
    got = {(r, i): e for r, i, _, _, e in decontaminate.hits(index, text, bounds)}
    rows = [text[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    true = {(r, i): e for r, t in enumerate(rows) for i, x in enumerate(index.texts) if (e := decontaminate.edit_distance(x, t)[0]) <= share * len(x)}
    assert got == true and len(true) > len(items)


def test_tables_find_copies_with_all_allowed_edits():
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("aeinorstlmdc"), rng.integers(2, 9))) for _ in range(2000)]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [words(int(rng.integers(14, 60))) for _ in range(150)]
    index = decontaminate.build_items(list(range(len(items))), items, 0.2, recall=0.99)
    assert index.walks and not index.scans  # nothing but tables leads to items

    def share(change):
        texts = [f"{words(7)} {change(t)} {words(9)}" for t in items]
        text, bounds, _ = decontaminate.normal(*flat(pa.array(texts)))
        rows = [text[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        due = {(r, r) for r, x in enumerate(rows) if decontaminate.edit_distance(index.texts[r], x)[0] <= 0.2 * len(index.texts[r])}
        return len(due), len(due & {(r, i) for r, i, *_ in decontaminate.hits(index, text, bounds)}) / len(due)

    every = lambda t, step: "".join("x" if k % step == step // 2 else c for k, c in enumerate(t))
    assert share(lambda t: t) == (150, 1.0)
    for step in (12, 10, 8, 6):
        due, found = share(lambda t, step=step: every(t, step))
        assert due > 140 and found >= 0.97, (step, due, found)
    for even in (True, False):
        due, found = share(lambda t, even=even: edited(rng, t, 0.19, even))
        assert due > 100 and found >= 0.95, (even, due, found)


def test_short_items_and_scripts_without_spaces(spark):
    rng = np.random.default_rng(9)
    signs = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9F00, n)))
    thai = "การทดสอบภาษาไทยโดยไม่มีช่องว่างระหว่างคำ"
    items = ["capital of france", "antarctica", signs(40), signs(6), thai, "\u300c" + signs(10) + "\u3002" + signs(10)]
    changed = items[2][:9] + signs(1) + items[2][10:25] + items[2][26:]
    texts = ["Is the Capital, of France ...", "in Antarctica!", signs(30) + items[2] + signs(30), signs(300) + changed, signs(9) + items[3] + signs(9), "ก" * 20 + thai + "ก" * 20, items[5].replace("\u3002", " ")[1:], signs(500)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    out = {r["doc_id"]: r["item_ids"] for r in decontaminate.find_items(frame(spark, texts), bench).collect()}
    assert [out[i] for i in range(8)] == [[0], [1], [2], [2], [3], [4], [5], []]


def test_many_passes_give_the_rows_of_one(spark, monkeypatch):
    items = [f"question number {w} about the river {w}" for w in ("amber", "birch", "cedar", "delta", "ebony", "fjord")]
    texts = [items[0], items[1] + " and " + items[2], None, "nothing of them"]
    docs = spark.createDataFrame([(i, t) for i in (7, 7, None, 8) for t in texts], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    one = sorted(decontaminate.find_items(docs, bench, max_edits=0.05).collect(), key=repr)
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    many = decontaminate.find_items(docs, bench, max_edits=0.05)
    assert sorted(many.collect(), key=repr) == one and len(one) == 16
    assert many.columns == ["doc_id", "contaminated", "n_items", "item_ids", "similarity", "hits"]


def test_many_passes_of_tables_and_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(22)
    words = lambda n: " ".join("".join(rng.choice(list("aeinorstlmdc"), 5)) for _ in range(n))
    items = [words(20) for _ in range(6)]
    docs = spark.createDataFrame([(i, t) for i in (1, 1, None) for t in (items[0], items[1] + " " + items[5], words(40), None)], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (5, items[5])], "item_id BIGINT, text STRING")  # repeated items count once
    one = sorted(decontaminate.find_items(docs, bench).collect(), key=repr)
    assert len(one) == 12 and sorted(r["item_ids"] for r in one if r["doc_id"] == 1) == [[], [], [], [], [0], [0], [1, 5], [1, 5]]
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 1)
    many = decontaminate.find_items(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_items"], r["item_ids"], r["similarity"]) for r in many) == sorted((r["doc_id"] or 0, r["n_items"], r["item_ids"], r["similarity"]) for r in one)
    assert decontaminate.find_items(docs.where("false"), bench).count() == 0


def test_long_items_with_few_edits():
    rng = np.random.default_rng(10)
    items = [" ".join("".join(rng.choice(list("aeinorst"), 6)) for _ in range(n)) for n in (60, 400, 900)]
    texts = [t[:3] + "x" + t[4:] for t in items] + [items[1][1500:], "a" + items[2] + "b", items[0][400:]]
    index = decontaminate.build_items([0, 1, 2], items, 0.002)
    text, bounds, _ = decontaminate.normal(*flat(pa.array(texts)))
    assert [(r, i, e) for r, i, _, _, e in decontaminate.hits(index, text, bounds)] == [(1, 1, 1), (2, 2, 1), (4, 2, 0)]


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 400, 30_000):
        lengths = np.clip(np.exp(rng.normal(5.5, 1.2, n)).astype(int), 1, 1024)
        h = np.bincount(lengths, minlength=1025)
        runs = packing.plan(h, 1024)
        seen, places = np.zeros(1025, int), {}
        for length, rank, count, seq, at in runs.tolist():
            assert rank == seen[length]
            seen[length] += count
            for s in range(seq, seq + count):
                places.setdefault(s, []).append((at, length))
        assert (seen == h).all()
        for p in places.values():
            at = 0
            for a, length in sorted(p):
                assert a == at
                at += length
            assert at <= 1024
        if n > 300:
            assert len(places) <= -(-int(lengths.sum()) // 1024) * 1.01 + 1


def test_nnls():
    rng = np.random.default_rng(6)
    a, x = rng.random((20, 8)), np.array([0, 2, 0, 1, 0, 0, 3, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-5)


def test_pack(spark):
    texts = ["one two", None, "", "two words " * 300, "x"] + ["same text here"] * 20
    df = frame(spark, texts, piece="c", length="d")
    out = packing.pack(df, WORDS, capacity=128).collect()
    lib = WordTokenizer(Path(WORDS).read_text()).library
    got = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == r["piece"] * 128 and r["length"] == len(r["ids"]) <= 128
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in by.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1].tolist()] and ends[-1] <= 128
    assert packing.pack(df.where("false"), WORDS).count() == 0


def test_pack_repeated_rows(spark):
    df = frame(spark, ["alpha beta " * 40, "short"])
    out = packing.pack(df.unionByName(df), WORDS, capacity=64, keep_ids=False).collect()
    alone = packing.pack(df, WORDS, capacity=64, keep_ids=False).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, out)) == sorted([*map(key, alone)] * 2)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:])) and places[0][1] == 0


def test_pieces_cut_batches_by_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c"])], ["t"])
    parts = list(pieces(b, "t", 12))
    assert [p.num_rows for p, _, _ in parts] == [2, 1, 1] and b"".join(d.tobytes() for _, d, _ in parts) == b"a" * 10 + b"b" * 50 + b"c"
