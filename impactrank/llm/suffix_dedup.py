"""Removal of repeated passages: every byte under a string of ``length`` bytes that also starts earlier.

Equality of long substrings is decided by suffix sorting (difference cover modulo 3,
see suffix_array).  Sorting every suffix of a corpus would shuffle many times its
size, so what provably cannot matter is left out first, without loss:

1. Every window of ``length`` bytes has an anchor, the byte k-gram of least hash in it
   (the last of equal ones).  Equal windows have equal anchors at equal places, so
   a window whose anchor's hash occurs once in the corpus is unique.  Consecutive
   windows with one anchor form a run.
2. Of runs with equal bytes the first stays; all windows of the others start earlier too.
3. An anchor with one distinct run left has nothing that could equal it.

The runs that remain, distinct texts around a shared anchor, are dealt by anchor
(large groups by the hash of the window too).  Windows whose core (all but a sixth of
their bytes) no other run of the anchor has are unique.  The suffixes of the texts left
are sorted, neighbours' prefixes compared, and the first of equal windows kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import drop_table, prepare, shared_dir, write_table
from ._text import mix, pieces, prefix_hash, range_hash, row_of
from .suffix_array import equal_prefixes

#: The filter of anchors that repeat has about 512 bits a row, 2**22 to 2**29 (64 MB are broadcast at most).
FILTER_LOG = (22, 29)
#: Rows whose anchors one group of the filter counts, about; slices in which its parts reach the driver.
FILTER_ROWS, SLICES = 500, 512
#: Distinct runs of an anchor that one group sorts at most, about; bytes sorted at once.
GROUP, SORT_BYTES = 2048, 1 << 19


def runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, number of windows, row and anchor offset of each run, and the running hash."""
    k = max(4, length // 3)
    w = length - k + 1
    n = len(data)
    running = prefix_hash(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty, empty, running
    at = np.arange(n - k + 1)
    value = range_hash(running, at, at + k)
    best = at.astype(np.int32)
    reach = 1
    low = value
    while reach < w:
        step = min(reach, w - reach)
        a, b = low[:-step], low[step:]
        right = b <= a
        low = np.where(right, b, a)
        best = np.where(right, best[step:], best[:-step])
        reach += step
    m = len(best)  # windows 0 .. n - length
    first = off[:-1]
    inside = np.zeros(m + 1, np.int32)
    have = np.diff(off) >= length
    np.add.at(inside, first[have], 1)
    np.add.at(inside, off[1:][have] - length + 1, -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (best[1:] != best[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
    return value[best[start]], start, stop - start, row_of(off, start), best[start] - start, running


def shared_cores(text: np.ndarray, size: np.ndarray, anchor: np.ndarray, lead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (row, start in text) that could equal one of another row: those whose core another row has.

    Windows are taken by the number of bytes before their anchor, in classes of a few; all
    windows of a class have a long core in common at the same place around the anchor.
    """
    k = max(4, length // 3)
    step = max(1, (length - k + 1) // 4)
    first, windows = np.cumsum(size) - size, size - length + 1
    running = prefix_hash(text)
    rows, keys, low_, high_ = [], [], [], []
    for low in range(0, length - k + 1, step):
        high = min(low + step - 1, length - k)
        most, least = np.minimum(lead, high), np.maximum(lead - windows + 1, low)
        some = np.flatnonzero(most >= least)
        at = first[some] + lead[some]
        core = range_hash(running, at - low, at + length - high)
        rows.append(some)
        keys.append(mix(core ^ mix(anchor[some].view(np.uint64) + np.uint64(low))))
        low_.append(least[some])
        high_.append(most[some])
    rows, keys, low_, high_ = (np.concatenate(x) for x in (rows, keys, low_, high_))
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    keep = count[back] > 1
    rows, low_, high_ = rows[keep], low_[keep], high_[keep]
    n = high_ - low_ + 1
    own = np.repeat(rows, n)
    before = np.repeat(low_, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    start = first[own] + lead[own] - before
    order = np.argsort(start, kind="stable")
    return own[order], start[order]


class _Repeats:
    def __init__(self, docs: DataFrame, length: int, id_col: str, text_col: str):
        self.spark = prepare(docs.sparkSession)
        named = docs.where(F.col(id_col).isNotNull())
        # Rows of one id are told apart by their text, where there are any; else the second part of the key is 0.
        self.repeats = not named.groupBy(id_col).count().where("count > 1").isEmpty()
        self.key = F.xxhash64(text_col) if self.repeats else F.lit(0).cast("long")
        self.docs = named.select(F.col(id_col).cast("long").alias("doc"), self.key.alias("key"), F.col(text_col).alias("text"))
        self.length, self.folder = length, shared_dir(docs.sparkSession)

    def repeated_anchors(self) -> np.ndarray:
        """Bit map of anchor hashes that occur twice or more, in the order of hashes.

        Hashes are dealt by their high bits to parts of bounded size, however many the
        corpus needs; a part's bits are a stretch of the map.  A full map only lets more through.
        """
        length = self.length
        rows = self.docs.count()
        bits = min(max(int(rows).bit_length() + 9, FILTER_LOG[0]), FILTER_LOG[1])
        parts = min(max((rows // FILTER_ROWS).bit_length(), 9), bits - 3)
        self.shift = place = np.uint64(64 - bits)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def out() -> pa.RecordBatch:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                part = (h >> np.uint64(64 - parts)).astype(np.int64)
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else np.zeros(0, np.int64)
                cut = [*zip(first.tolist(), [*first[1:].tolist(), len(h)])]
                once = [h[a:b][c[a:b] == 1].tobytes() for a, b in cut]
                more = [h[a:b][c[a:b] > 1].tobytes() for a, b in cut]
                return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["part", "once", "more"])

            for batch in batches:
                for _, data, off in pieces(batch, "text", 1 << 19):
                    held.append(runs(data, off, length)[0])
                    size += len(held[-1])
                    if size > 500_000:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()

        def marked(group: pa.Table) -> pa.Table:
            once = np.frombuffer(b"".join(group.column("once").to_pylist()), np.uint64)
            more = np.frombuffer(b"".join(group.column("more").to_pylist()), np.uint64)
            h, c = np.unique(np.concatenate([once, more, more]), return_counts=True)
            part = group.column("part")[0].as_py()
            on = np.zeros(1 << (bits - parts), bool)
            on[((h[c > 1] >> place) - np.uint64(part << (bits - parts))).astype(np.int64)] = True
            return pa.table({"part": pa.array([part]), "map": pa.array([np.packbits(on).tobytes()], pa.binary())})

        seen = self.docs.mapInArrow(local, "part long, once binary, more binary").groupBy("part").applyInArrow(marked, "part long, map binary")
        # At most 2**29 / SLICES bits in a slice, as 2**20 parts of one byte at most.
        slices = seen.groupBy(F.expr(f"part div {max(1, (1 << parts) // SLICES)}").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("parts"))
        out, wide = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - parts - 3)
        for row in slices.toLocalIterator():  # at most 64 MB in all
            for x in row["parts"]:
                out[x["part"] * wide : (x["part"] + 1) * wide] = np.frombuffer(x["map"], np.uint8)
        return out

    def candidates(self) -> DataFrame:
        """(anchor, content, doc, key, start, windows, lead) of runs whose anchor repeats; lead is the anchor's offset."""
        sent, length = self.spark.sparkContext.broadcast(self.repeated_anchors()), self.length
        shift = self.shift

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            for batch in batches:
                for part, data, off in pieces(batch, "text", 1 << 19):
                    anchor, start, count, row, lead, running = runs(data, off, length)
                    bit = (anchor >> shift).astype(np.int64)
                    keep = (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
                    anchor, start, count, row, lead = anchor[keep], start[keep], count[keep], row[keep], lead[keep]
                    content = range_hash(running, start, start + count - 1 + length)
                    doc, key = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc[row]), pa.array(key[row]), pa.array(start - off[row]), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32))], ["anchor", "content", "doc", "key", "start", "windows", "lead"])

        return self.docs.mapInArrow(run, "anchor long, content long, doc long, key long, start long, windows int, lead int")

    def duplicates(self) -> DataFrame:
        """(doc, key, first, end): byte ranges to remove; they may overlap."""
        length = self.length
        held = write_table(self.candidates(), self.folder, "candidates")
        firsts = write_table(held.groupBy("anchor", "content", "windows").agg(F.min(F.struct("doc", "key", "start", "lead")).alias("at"), F.count("*").alias("n")), self.folder, "firsts")
        more = firsts.where("n > 1").select("anchor", "content", "windows", "at")
        copies = held.join(more, ["anchor", "content", "windows"]).where("doc <> at.doc OR key <> at.key OR start <> at.start").select("doc", "key", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1 + length).alias("end"))
        copies = write_table(copies, self.folder, "copies")
        variants = firsts.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1")
        open_ = firsts.join(variants, "anchor").select("anchor", "variants", F.col("at.doc").alias("doc"), F.col("at.key").alias("key"), F.col("at.start").alias("start"), "windows", F.col("at.lead").alias("lead"))
        wanted = open_.groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "variants", "start", "windows", "lead")).alias("runs"))  # runs of one document

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = pieces_all(batch)
                lists = batch.column("runs")
                row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                inner = lists.flatten()
                anchor, variants, start, windows, lead = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                parts = -(-variants // GROUP)
                begin = off[row] + start
                out: list[tuple[int, int]] = []
                for i in np.flatnonzero(parts > 1).tolist():
                    a = np.arange(begin[i], begin[i] + windows[i])
                    text = data[begin[i] : begin[i] + windows[i] - 1 + length]
                    h = range_hash(prefix_hash(text), a - begin[i], a - begin[i] + length)
                    out += [(i, p) for p in np.unique(h % np.uint64(parts[i])).tolist()]
                which = np.concatenate([np.flatnonzero(parts == 1), np.array([x for x, _ in out], np.int64)])
                part = np.concatenate([np.zeros(int((parts == 1).sum()), np.int64), np.array([p for _, p in out], np.int64)])
                blob = data.tobytes()
                texts = [blob[a:b] for a, b in zip(begin[which].tolist(), (begin[which] + windows[which] - 1 + length).tolist())]
                doc, key = batch.column("doc").to_numpy()[row], batch.column("key").to_numpy()[row]
                for a in range(0, max(len(which), 1), 20_000):
                    s = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[which][s]), pa.array(part[s]), pa.array(parts[which][s].astype(np.int64)), pa.array(doc[which][s]), pa.array(start[which][s]), pa.array(texts[s], pa.binary()), pa.array(lead[which][s].astype(np.int64)), pa.array(key[which][s])], ["anchor", "part", "parts", "doc", "start", "text", "lead", "key"])

        def pieces_all(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            from ._text import flat

            return flat(batch.column("text"))

        docs = self.docs.dropDuplicates(["doc", "key"]) if self.repeats else self.docs
        texts = docs.join(wanted, ["doc", "key"]).select("doc", "key", "text", "runs").mapInArrow(cut, "anchor long, part long, parts long, doc long, start long, text binary, lead long, key long")
        dealt = texts.repartition("anchor", "part").sortWithinPartitions("anchor", "part")

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            size = np.array([len(r[5]) for r in rows], np.int64)
            own, start = shared_cores(text, size, np.array([r[0] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64), length)
            # Sort only the texts that still have a window.
            used = np.unique(own)
            kept = np.zeros(len(rows), np.int64)
            kept[used] = np.arange(len(used))
            first = np.cumsum(size) - size
            inside = start - first[own]
            rows, size = [rows[i] for i in used.tolist()], size[used]
            text, end = np.frombuffer(b"".join(r[5] for r in rows), np.uint8), np.cumsum(size)
            own = kept[own]
            start = (end - size)[own] + inside
            parts, part = np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            if (parts > 1).any():
                h = range_hash(prefix_hash(text), start, start + length)
                mine = (h % parts[own].astype(np.uint64)).astype(np.int64) == part[own]
                own, start = own[mine], start[mine]
            # A symbol of its own after each text keeps windows apart.
            s = np.insert(text.astype(np.int64) + 2, end, 1)
            group = equal_prefixes(s, start + own, length)
            doc, place = np.array([r[3] for r in rows], np.int64)[own], np.array([r[4] for r in rows], np.int64)[own] + start - (end - size)[own]
            key = np.array([r[7] for r in rows], np.int64)[own]
            order = np.lexsort((place, key, doc, group))
            g = group[order]
            earlier = np.zeros(len(g), bool)
            earlier[1:] = (g[1:] == g[:-1])
            hit = np.zeros(len(g), bool)
            hit[order] = earlier
            k = np.flatnonzero(hit)
            begin = k[np.append(True, (k[1:] != k[:-1] + 1) | (own[k[1:]] != own[k[:-1]]) | (place[k[1:]] != place[k[:-1]] + 1))] if len(k) else k
            stop = k[np.append((k[1:] != k[:-1] + 1) | (own[k[1:]] != own[k[:-1]]) | (place[k[1:]] != place[k[:-1]] + 1), True)] if len(k) else k
            return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(key[begin]), pa.array(place[begin]), pa.array(place[stop] + length)], ["doc", "key", "first", "end"])

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, size, last = [], 0, None
            for batch in batches:
                for r in zip(*(batch.column(i).to_pylist() for i in range(8))):
                    if size > SORT_BYTES and (r[0], r[1]) != last:
                        yield settle(rows)
                        rows, size = [], 0
                    rows.append(r)
                    size += len(r[5])
                    last = (r[0], r[1])
            if rows:
                yield settle(rows)

        sorted_out = write_table(dealt.mapInArrow(sort, "doc long, key long, first long, end long"), self.folder, "sorted")
        return copies.unionByName(sorted_out)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, apart by at least one byte, in order."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, ranges: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the ranges removed."""
    cut = merged([(x["first"], x["end"]) for x in ranges or ()])
    at, left = 0, []
    for a, b in cut:
        left.append(text[at:a])
        at = b
    return b"".join([*left, text[at:]]), cut


def _ranges(work: _Repeats) -> DataFrame:
    """(doc, key, ranges) of documents that lose bytes; drops the scratch tables."""
    found = work.duplicates().groupBy("doc", "key").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))  # ranges of one document
    found = write_table(found, work.folder, "ranges")
    for name in ("candidates", "firsts", "copies", "sorted"):
        drop_table(work.spark, work.folder, name)
    return found


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: n_bytes, n_removed, n_spans, ``spans`` (removed byte ranges) and ``kept``.

    Texts are UTF-8 bytes (null: empty).  A byte goes if some ``length`` bytes over it
    also start earlier: in a document of smaller id, or before in the same one.
    Matches never cross documents, overlapping ones count, and all are judged on the
    input.  ``kept`` holds the bytes left; with ``digest`` the columns spans and kept
    give way to ``kept_sha256``.  Texts shorter than ``length`` stay as they are.
    Rows of one id and different texts are documents of their own, in an order of theirs;
    repeated rows of one id and text are one document and each has its row.  Rows
    without an id have no row.  Other columns are left out.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    work = _Repeats(docs, length, id_col, text_col)
    ranges = _ranges(work)
    tail = "kept_sha256 string" if digest else "spans array<struct<start: long, end: long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in pieces(batch, "text", 1 << 20):
                blob = data.tobytes()
                n, removed, spans, kept = np.diff(off), [], [], []
                for i, found in enumerate(part.column("ranges").to_pylist()):
                    text = blob[off[i] : off[i + 1]]
                    left, cut = kept_bytes(text, found)
                    removed.append(len(text) - len(left))
                    spans.append(cut)
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                out = [part.column("doc"), pa.array(n), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64())]
                names = [id_col, "n_bytes", "n_removed", "n_spans"]
                if digest:
                    out, names = [*out, pa.array(kept, pa.string())], [*names, "kept_sha256"]
                else:
                    as_rows = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                    out, names = [*out, as_rows, pa.array(kept, pa.binary())], [*names, "spans", "kept"]
                yield pa.RecordBatch.from_arrays(out, names)

    held = work.docs.join(ranges, ["doc", "key"], "left").select("doc", "text", "ranges")
    return held.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, {tail}")


def cut_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the bytes that remove_repeats() removes cut from the text, and ``_cut``: whether any were.

    Halves of characters at a cut go as well.  Texts that lose nothing, null ones and
    rows without an id stay as they are.
    """
    work = _Repeats(docs, length, id_col, text_col)
    ranges = _ranges(work).select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), F.col("ranges").alias("_ranges"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_cut", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = batch.schema.get_field_index(text_col), batch.column("_ranges").to_pylist()
            hit = [i for i, x in enumerate(found) if x]
            columns = batch.columns[:-1]
            if hit:
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i] = kept_bytes(texts[i].encode(), found[i])[0].decode("utf-8", "ignore")
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in found], pa.bool_())], [*batch.schema.names[:-1], "_cut"])

    same = (F.col(id_col).cast("long") == F.col("_doc")) & (work.key == F.col("_key"))
    return docs.join(ranges, same, "left").select(*docs.columns, "_ranges").mapInArrow(run, schema)
