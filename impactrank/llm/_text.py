"""Shared numpy text kernels: Arrow string columns as flat byte arrays, and
64-bit polynomial hashes of any byte range in O(1) after one pass.

Nothing here creates one Python object per word; a document of any length is
handled whole.  Memory is a small multiple of ``CHUNK_BYTES`` or of the longest
single document, whichever is larger.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None

#: Bytes of text that a kernel works on at once.
CHUNK_BYTES = 4 << 20
#: Rows that Spark puts into one Arrow batch for the text operators.
BATCH_ROWS = 400

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers, _inverse_powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[:n], _inverse_powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running hash of a byte array; input to range_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = _BYTE_VALUE[data]
    values *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def range_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[start:end] for arrays of bounds."""
    h = running[end] - running[start]
    h *= powers(len(running))[1][start]
    h += (end - start).astype(np.uint64)
    return mix(h)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column on end, and row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` bytes of one text column."""
    data, off = flat(batch.column(name))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end
    release()


def release() -> None:
    """Give freed memory back to the system: workers live as long as the executor and serve many tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_of(off: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each ascending byte position lies in."""
    return np.searchsorted(off, positions, "right") - 1


def space_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than space and 09-0D."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = _NOT_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(edge[:-1])
    ends = np.append(at[1:], len(data))
    keep = word[at]
    return at[keep], ends[keep], row_of(off, at[keep])


_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class SegmentCache:
    """Per-process map from the hash of a short byte string to a list of ids.

    ``encode`` turns a list of byte strings into a list of id lists.  It holds at
    most ``limit`` strings; beyond that it starts anew, which costs time only.
    """

    def __init__(self, encode, limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def lookup(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each segment, as (first, count) into self.ids."""
        unique, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self.clear()
        place = np.searchsorted(self.keys, unique)
        place_in = np.minimum(place, max(len(self.keys) - 1, 0))
        known = self.keys[place_in] == unique if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes() if len(new) * 64 > len(data) else None
            s, e = start[at[new]].tolist(), end[at[new]].tolist()
            texts = [raw[a:b] for a, b in zip(s, e)] if raw is not None else [data[a:b].tobytes() for a, b in zip(s, e)]
            flat_ids, counts = self.encode(texts)
            first = len(self.ids) + np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)]).astype(np.int64)
            self.ids = np.concatenate([self.ids, flat_ids.astype(np.int32)])
            keys_all = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys_all, kind="stable")
            self.keys = keys_all[order]
            self.first = np.concatenate([self.first, first])[order]
            self.count = np.concatenate([self.count, counts.astype(np.int32)])[order]
            place_in = np.searchsorted(self.keys, unique)
        return self.first[place_in][back], self.count[place_in][back]

    def gather(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of segments on end."""
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(first - (ends - count), count)
        return self.ids[np.arange(total, dtype=np.int64) + shift]
