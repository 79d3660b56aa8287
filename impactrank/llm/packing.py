"""Best-fit packing of tokenized documents into sequences of fixed capacity.

The plan is made on the histogram of lengths alone (at most ``capacity`` numbers,
whatever the corpus): patterns of up to three documents that fill a sequence are
enumerated on a length grid, non-negative least squares fits their repeat counts to
the histogram, counts are rounded down, and the residue goes, longest first, into
the tightest space left.  The plan is a list of runs, "``count`` documents of this
length, from this rank on, lie at this offset of consecutive sequences"; a document
finds its place from its length and its rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import drop_table, prepare, shared_dir, write_table
from ._text import pieces
from ._tokenizers import WordTokenizer

_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer(spec: str) -> WordTokenizer:
    """This process's tokenizer for a specification, with the words it has seen."""
    key = hash(spec)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(spec)
    return _tokenizers[key]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least squares with non-negative unknowns, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    limit = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = right - gram @ x
        gradient[free] = -np.inf
        k = int(np.argmax(gradient))
        if gradient[k] <= limit:
            break
        free[k] = True
        while True:
            on = np.flatnonzero(free)
            z = np.linalg.solve(gram[np.ix_(on, on)] + 1e-10 * np.eye(len(on)), right[on])
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            down = z <= 0
            step = np.min(x[on][down] / np.maximum(x[on][down] - z[down], 1e-300))
            x[on] += step * (z - x[on])
            free[on[(x[on] <= 1e-12) | (down & (x[on] <= 1e-9))]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(bins: int) -> np.ndarray:
    """All multisets of one to three grid lengths whose sum is ``bins``; rows of three, 0 for none."""
    return np.array([(i, j, bins - i - j) for i in range(1, bins + 1) for j in range(min(i, bins - i) + 1) if 0 <= bins - i - j <= j])


def plan(histogram: np.ndarray, capacity: int, grid: int = 32) -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset) that place every document once.

    ``histogram[n]`` counts the pieces of n tokens, 1 <= n <= capacity.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    spaces: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, count)
    sequences = 0

    def take(length: int, n: int, seq: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, seq, offset))
        used[length] += n
        left[length] -= n

    bins = capacity // grid
    if bins >= 1 and bins * grid == capacity and left.any():
        up = (np.arange(capacity + 1) + grid - 1) // grid
        have = np.bincount(up, weights=left, minlength=bins + 1)
        shapes = patterns(bins)
        a = np.zeros((bins + 1, len(shapes)))
        for slot in range(3):
            np.add.at(a, (shapes[:, slot], np.arange(len(shapes))), 1)
        a, weight = a[1:], np.sqrt(np.arange(1, bins + 1) / bins)  # a short piece left over costs little
        counts = np.floor(nnls(a * weight[:, None], have[1:] * weight) + 1e-6).astype(np.int64)
        for k in np.argsort(-shapes[:, 0], kind="stable"):
            shape = shapes[k][shapes[k] > 0]
            need = np.bincount(shape, minlength=bins + 1)
            n = int(min([counts[k], *(have[b] // need[b] for b in set(shape.tolist()))]))
            while n > 0:
                # The longest lengths of each slot's bin, and for the last slot the one that
                # fills what the grid has left over; as many sequences at once as they last.
                lengths, still = [], {}
                for slot, b in enumerate(shape.tolist()):
                    top = capacity - sum(lengths) if slot == len(shape) - 1 else min(b * grid, capacity)
                    inside = range(top, (b - 1) * grid, -1)
                    got = next(x for x in inside if left[x] - still.get(x, 0) > 0)
                    still[got] = still.get(got, 0) + 1
                    lengths.append(got)
                m = min([n, *(int(left[x]) // c for x, c in still.items())])
                offset = 0
                for x in lengths:
                    take(x, m, sequences, offset)
                    have[up[x]] -= m
                    offset += x
                if offset < capacity:
                    spaces.setdefault(capacity - offset, []).append((sequences, m))
                sequences += m
                n = int(min([n - m, *(have[b] // need[b] for b in set(shape.tolist()))]))
    open_ = np.zeros(capacity + 2, bool)
    open_[list(spaces)] = True
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            fit = length + int(np.argmax(open_[length:]))
            if open_[fit]:
                seq, n = spaces[fit].pop()
                m, each = min(n, int(left[length])), 1
                if m < n:
                    spaces[fit].append((seq + m, n - m))
                open_[fit] = bool(spaces[fit])
            else:
                each, fit, seq = min(capacity // length, int(left[length])), capacity, sequences
                m = int(left[length]) // each
                sequences += m
            for slot in range(each):
                take(length, m, seq, capacity - fit + slot * length)
            rest = fit - each * length
            if rest:
                spaces.setdefault(rest, []).append((seq, m))
                open_[rest] = True
    return np.array(runs, np.int64).reshape(-1, 5)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token pieces of each document: ids (or, without ``keep_ids``, their CRC-32) and length.

    A document's ids end with ``end_id``, so a null or empty text has one token.
    Longer ones are cut every ``capacity`` ids.  ``part`` and ``rank`` number the
    pieces of equal length in a task.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = tokenizer(spec.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for rows, data, off in pieces(batch, text_col):
                ids, counts = words.encode(data, off)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                begin = np.cumsum(counts) - counts
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                first = begin[doc] + start
                raw = memoryview(ids.tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist())), np.int64, len(doc))
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
                sizes = np.diff(np.append(new, len(by)))
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - np.repeat(new, sizes) + seen[by]
                seen[by[new]] += sizes
                out = [rows.column(id_col).cast(pa.int64()).take(pa.array(doc)), *map(pa.array, (piece.astype(np.int32), start, length, crc, np.full(len(doc), part, np.int32), rank))]
                names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and offset there.

    Offsets within a sequence are gapless from 0.  Null and empty texts are one
    end token; repeated rows are packed as often as they occur; an empty table
    gives an empty result.  Only the histogram (at most ``capacity`` rows) comes to
    the driver and only the runs, whose number depends on ``capacity`` alone, are
    broadcast.  Equal lengths, however many, are ranked by task and summed over
    tasks, so no task sees more than its share.
    """
    spark = prepare(docs.sparkSession)
    folder = shared_dir(spark)
    held = write_table(tokenized(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids), folder, "pieces")
    by_task = write_table(held.groupBy("part", "length").agg(F.count("*").alias("n")), folder, "by_task")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    runs = plan(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = spark.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    placed = held.join(base, (held.part == base.p) & (held.length == base.l)).withColumn("rank", F.col("rank") + F.col("base")).drop("p", "l", "base", "part")
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        key = r[:, 0] << 44 | r[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            got = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(r[k, 3] + rank - r[k, 1]), pa.array(r[k, 4])], [*got.schema.names, "sequence_id", "offset"])

    return placed.mapInArrow(run, schema)
