"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded and convolved with learned filters over overlapping chunks that
cover the whole document.  Each chunk keeps every filter's largest response; the
document keeps their mean, largest and smallest over chunks, from which one logistic
unit makes the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare
from ._text import flat, pieces

WIDTH, STRIDE, DIM, FILTERS = 8, 2, 8, 24
#: Filter positions in a chunk, and from one chunk to the next.
CHUNK, HOP = 128, 64


@dataclass
class Network:
    embed: np.ndarray  # (257, DIM); the last row is padding
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (3 * FILTERS)
    out_bias: float


def layout(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded text bounds, and per chunk its first position, end position and document.

    Every document gets one chunk at least, and padding so that each byte lies under a filter.
    """
    length = np.diff(off)
    positions = np.maximum(1, -(-np.maximum(length - WIDTH, 0) // STRIDE) + 1)
    chunks = np.maximum(1, -(-np.maximum(positions - CHUNK, 0) // HOP) + 1)
    first = np.cumsum(positions) - positions
    doc = np.repeat(np.arange(len(length)), chunks)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[doc] + k * HOP
    end = np.minimum(begin + CHUNK, first[doc] + positions[doc])
    return positions, first, begin, end, doc


def responses(net: Network, data: np.ndarray, off: np.ndarray, positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter responses at every position of every document, on end."""
    doc = np.repeat(np.arange(len(positions)), positions)
    at = off[doc] + (np.arange(len(doc)) - first[doc]) * STRIDE
    stop = off[doc + 1]
    out = np.empty((len(doc), FILTERS), np.float32)
    code = data.astype(np.int16)
    taps = np.arange(WIDTH)
    for a in range(0, len(doc), 1 << 15):
        b = slice(a, a + (1 << 15))
        place = at[b, None] + taps
        byte = np.where(place < stop[b, None], code[np.minimum(place, max(len(code) - 1, 0))] if len(code) else 256, 256)
        out[b] = net.embed[byte].reshape(len(byte), -1) @ net.filters
    return out + net.bias


def chunk_max(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest response per chunk; chunks overlap, so halves are reduced first."""
    cut = np.empty(2 * len(begin), np.int64)
    cut[0::2], cut[1::2] = begin, np.minimum(end, len(values) - 1)
    got = np.maximum.reduceat(values, cut, axis=0)[0::2]
    last = end == len(values)
    if last.any():  # reduceat above stops one short of the end for these
        got[last] = np.maximum(got[last], values[-1])
    return got


def forward(net: Network, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each document."""
    positions, first, begin, end, doc = layout(off)
    pooled = np.maximum(chunk_max(responses(net, data, off, positions, first), begin, end), 0)
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    count = np.diff(np.append(new, len(doc)))[:, None]
    features = np.concatenate([np.add.reduceat(pooled, new) / count, np.maximum.reduceat(pooled, new), np.minimum.reduceat(pooled, new)], 1)
    return 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by Adam on the logistic loss; gradients pass through the maxima alone."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (257, DIM)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 3 * FILTERS).astype(np.float32), 0.0)
    net.embed[256] = 0
    p = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    net.out_bias = float(np.log(p / (1 - p)))
    if not len(texts) or labels.min() == labels.max():
        net.out[:] = 0
        return net
    slots = ["embed", "filters", "bias", "out", "out_bias"]
    m1, m2, step = {s: 0.0 for s in slots}, {s: 0.0 for s in slots}, 0
    for epoch in range(epochs):
        perm = rng.permutation(len(texts))
        for a in range(0, len(perm), batch):
            pick = perm[a : a + batch]
            data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])]).astype(np.int64)
            y = labels[pick].astype(np.float32)
            positions, first, begin, end, doc = layout(off)
            r = responses(net, data, off, positions, first)
            # Where each chunk's maxima lie.
            width = int((end - begin).max())
            place = np.minimum(begin[:, None] + np.arange(width), (end - 1)[:, None])
            where = np.take_along_axis(place, r[place].argmax(1), 1)  # (chunks, FILTERS)
            raw = r[where, np.arange(FILTERS)]
            pooled = np.maximum(raw, 0)
            new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            count = np.diff(np.append(new, len(doc)))
            mean, top, low = np.add.reduceat(pooled, new) / count[:, None], np.maximum.reduceat(pooled, new), np.minimum.reduceat(pooled, new)
            features = np.concatenate([mean, top, low], 1)
            prob = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30)))
            g = (prob - y) / len(pick)
            gf = g[:, None] * net.out
            gp = np.repeat(gf[:, :FILTERS] / count[:, None], count, 0)
            for part, best in ((gf[:, FILTERS : 2 * FILTERS], top), (gf[:, 2 * FILTERS :], low)):
                hit = pooled == np.repeat(best, count, 0)
                share = np.add.reduceat(hit.astype(np.float32), new)
                gp += np.repeat(part / share, count, 0) * hit
            gp *= raw > 0
            c, f = np.nonzero(gp)
            value, pos = gp[c, f].astype(np.float32), where[c, f]
            own = doc[c]
            byte_at = off[own] + (pos - first[own]) * STRIDE
            place = byte_at[:, None] + np.arange(WIDTH)
            byte = np.where(place < off[own + 1][:, None], data[np.minimum(place, len(data) - 1)] if len(data) else 256, 256)
            x = net.embed[byte].reshape(len(byte), -1)
            gfilters = np.zeros_like(net.filters)
            for k in range(FILTERS):
                mine = f == k
                gfilters[:, k] = value[mine] @ x[mine]
            gx = (value[:, None] * net.filters[:, f].T).reshape(len(f), WIDTH, DIM)
            gembed = np.zeros_like(net.embed)
            for d in range(DIM):
                gembed[:, d] = np.bincount(byte.ravel(), weights=gx[:, :, d].ravel(), minlength=257)
            gembed[256] = 0
            grads = {"embed": gembed, "filters": gfilters, "bias": np.bincount(f, weights=value, minlength=FILTERS), "out": features.T @ g, "out_bias": float(g.sum())}
            step += 1
            lr = rate * (1 - epoch / epochs) ** 0.5
            for s in slots:
                grad = grads[s]
                m1[s] = 0.9 * m1[s] + 0.1 * grad
                m2[s] = 0.999 * m2[s] + 0.001 * grad * grad
                move = lr * (m1[s] / (1 - 0.9**step)) / (np.sqrt(m2[s] / (1 - 0.999**step)) + 1e-8)
                setattr(net, s, (getattr(net, s) - move).astype(np.float32) if s != "out_bias" else getattr(net, s) - float(move))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 5) -> Network:
    """Learn from about ``rows`` labelled documents, whole, taken by the hash of their id.

    Rows with a null label count for nothing; a null text is empty.  Without rows, or
    with one label only, every score is the label's share (0.5 without rows).
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    n = known.count()
    taken = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < (rows / max(n, 1)) * 1_000_003)
    # About ``rows`` small rows, by the line above.
    held = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(taken), "_id").orderBy("_id", "_y").select("_t", "_y").toArrow()
    data, off = flat(held.column(0)) if held.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    texts = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
    return train(texts, np.array(held.column(1).to_pylist(), np.int64), seed=seed)


def score(docs: DataFrame, net: Network, cutoff: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: score (probability of label 1) and predicted (score >= cutoff).

    Null and empty texts are scored as padding alone.  Repeated rows each have a row;
    other columns are left out.  No shuffle; memory is bounded by the longest text.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in pieces(batch, text_col, 1 << 20):
                p = forward(sent.value, data, off).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(p), pa.array((p >= cutoff).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double, predicted int")
