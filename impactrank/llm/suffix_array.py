"""Suffix arrays by the difference cover modulo 3, in numpy."""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples, from 0, in tuple order."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if (int(out.max(initial=0)) + 1) * wide >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * wide + c
    return np.unique(out, return_inverse=True)[1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s (integers above 0) in ascending order.

    Suffixes at positions 1 and 2 modulo 3 are the sample: their triples are sorted and
    named, and the string of names is sorted by recursion unless names are distinct
    already.  The others are ordered by their first symbol and the rank that follows,
    and merged into the sample by binary search.
    """
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:].tolist())), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    name = _names(t[sample], t[sample + 1], t[sample + 2])
    if name.max() + 1 < len(sample):
        order = suffix_array(name + 1)
    else:
        order = np.empty(len(sample), np.int64)
        order[name] = np.arange(len(sample))
    rank = np.zeros(n + 5, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rank[n] = 0 if n % 3 else rank[n]
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    low, high = np.zeros(len(zero), np.int64), np.full(len(zero), len(sorted_sample), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        mid = (low[open_] + high[open_]) // 2
        i, j = zero[open_], sorted_sample[mid]
        first = t[i] - t[j]
        by_one = np.where(first != 0, first, rank[i + 1] - rank[j + 1])
        second = t[i + 1] - t[j + 1]
        by_two = np.where(first != 0, first, np.where(second != 0, second, rank[i + 2] - rank[j + 2]))
        less = np.where(j % 3 == 1, by_one, by_two) < 0
        high[open_[less]] = mid[less]
        low[open_[~less]] = mid[~less] + 1
    out = np.empty(n, np.int64)
    at = low + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted_sample
    return out


def equal_prefixes(s: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Group number of each start: equal numbers where ``length`` symbols are equal.

    Suffixes are sorted, and the prefixes of neighbours among ``starts`` compared.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    place = np.full(len(s), -1, np.int64)
    place[starts] = np.arange(len(starts))
    order = place[suffix_array(s)]
    order = order[order >= 0]
    at = starts[order]
    same = np.ones(len(at) - 1, bool)
    live = np.arange(len(at) - 1)
    for k in range(length):
        ok = s[at[live] + k] == s[at[live + 1] + k]
        same[live[~ok]] = False
        live = live[ok]
        if not len(live):
            break
    group = np.empty(len(at), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    return group
