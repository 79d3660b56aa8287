"""Merge ranks applied to many byte strings at once, in numpy.

Byte-pair encoding joins, again and again, the adjacent pair of lowest rank.  All
strings take that step together, so the cost is a few array passes per round.
"""

from __future__ import annotations

import numpy as np


class PairTable:
    """Open-addressing table from a pair of ids to (rank, joined id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(12, int(np.ceil(np.log2(max(len(key), 1) * 8))))
        size = 1 << self.bits
        self.key = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, np.iinfo(np.int32).max, np.int32)
        self.joined = np.zeros(size, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            empty = self.key[slot[todo]] == np.uint64(2**64 - 1)
            can = todo[empty]
            _, first = np.unique(slot[can], return_index=True)
            put = can[first]
            self.key[slot[put]], self.rank[slot[put]], self.joined[slot[put]] = key[put], put, joined[put]
            done = np.zeros(len(key), bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = np.where(self.key[slot[todo]] != np.uint64(2**64 - 1), (slot[todo] + 1) % size, slot[todo])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; slots of absent pairs have the largest rank."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        there = self.key[slot]
        off = np.flatnonzero((there != key) & (there != np.uint64(2**64 - 1)))
        while len(off):
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            there = self.key[slot[off]]
            off = off[(there != key[off]) & (there != np.uint64(2**64 - 1))]
        return slot


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Encode strings given as ids on end; returns ids on end and counts.

    Each round joins in every string its leftmost pair of lowest rank.
    """
    none = np.iinfo(np.int32).max
    n = len(lengths)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    word = np.repeat(np.arange(n), lengths)
    sym = symbols.astype(np.int32)
    slot = np.zeros(len(sym), np.int64)
    if len(sym):
        slot[:-1] = table.find(sym[:-1], sym[1:])
    rank = table.rank[slot]
    if len(sym):
        rank[:-1][word[1:] != word[:-1]] = none
        rank[-1] = none
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(sym)))
        best = np.minimum.reduceat(rank, starts)
        open_ = best != none
        if not open_.all():
            closed = np.repeat(~open_, sizes)
            out.append((word[closed], sym[closed]))
            keep = ~closed
            word, sym, rank, slot = word[keep], sym[keep], rank[keep], slot[keep]
            sizes, best = sizes[open_], best[open_]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
        sym[hit] = table.joined[slot[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        gone_before = np.cumsum(~keep)
        word, sym, rank, slot = word[keep], sym[keep], rank[keep], slot[keep]
        at = hit - gone_before[hit]
        left = at[at > 0] - 1
        change = np.unique(np.concatenate([left[word[left] == word[left + 1]], at]))
        last = change + 1 >= len(sym)
        inner = change[~last]
        slot[inner] = table.find(sym[inner], sym[inner + 1])
        rank[inner] = np.where(word[inner] == word[inner + 1], table.rank[slot[inner]], none)
        rank[change[last]] = none
    if not out:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    w, s = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    order = np.argsort(w, kind="stable")
    return s[order], np.bincount(w, minlength=n)
