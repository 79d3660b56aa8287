"""Benchmark items in documents, found up to edits.

Items and texts are reduced to lower-case letters and digits with single spaces.  A
random walk (CGK embedding) reads a string from some byte on: at each step it puts out
the byte it is at, and a coin that depends on the step and the byte tells whether it
moves on.  Walks over two strings that differ by an edit fall in step again, so edit
distance becomes Hamming distance of what they put out.  A table samples some of
the steps; equal samples of a walk in the text and a walk in an item make a window of
the item's size a candidate, wherever in the window and the item the walks start:
item walks start at every byte (about START_BYTES of them in long items, at an odd
distance), text walks at every ``stride`` bytes, so every alignment has many tries.

Tables are added until copies of the items, edited by all that is allowed (evenly spaced
substitutions, and edits of all kinds anywhere), are found as often as ``recall`` asks.
The edit distance of a part of the item about the walk, for many candidates at once, decides whether to go on;
the edit distance of the whole item decides in the end.

Items too short for walks, and all items if the tables cannot reach the recall or none
may be lost (a recall of 1), are cut into pieces instead so that a passage within the allowed edits holds a piece
with one edit or none; every window of a text is looked up with one of its bytes left out, among
pieces with one byte left out.  That way loses no passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare, shared_dir, write_table
from ._text import pieces, row_of

#: Bytes of a window less one; they are compared as one number.
WINDOW = 8
#: Positions, and groups, worked on at once.
STRETCH, LANES = 1 << 17, 1 << 14
#: Reduced bytes of items in one pass over the documents: tables take about 200 times as much.
PASS_BYTES = 256 << 10
#: Items in one pass at most.
ITEMS_PER_PASS = 20_000
#: Walks that start in one item, about.
START_BYTES = 1024
#: Least bytes of an item, steps of a walk, steps sampled by a table, distance of the walks in texts.
WALKS = ((64, 32, 12, 4), (32, 16, 7, 4))
#: Tables that share a walk; tables at first, and at most.
SHARED, LEAST_TABLES, MOST_TABLES = 3, 6, 24
#: Items whose edited copies measure the recall.
MEASURED = 200
#: Fewer bytes of reduced text tell nothing.
LEAST_BYTES = 10

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = True
_KEEP[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced text on end, row offsets in it, and each byte's place in the original.

    Every row begins and ends without a space; general punctuation beyond ASCII (U+2000
    to U+206F, U+3000 to U+303F, U+00A0 to U+00BF) separates like ASCII punctuation.
    """
    if not len(data):
        return data, off * 0, np.zeros(0, np.int64)
    keep = _KEEP[data]
    nxt = np.append(data[1:], 0)
    sign = (data == 0xC2) & (nxt >= 0xA0) & (nxt <= 0xBF)
    wide = (data[:-2] == 0xE2) & (data[1:-1] == 0x80) | (data[:-2] == 0xE2) & (data[1:-1] == 0x81) & (data[2:] <= 0xAF) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80) if len(data) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(sign)
    keep[at] = keep[at + 1] = False
    at = np.flatnonzero(wide)
    keep[at] = keep[at + 1] = keep[at + 2] = False
    low = _LOWER[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
    c3 = c3[(data[c3] >= 0x80) & (data[c3] <= 0x9E) & (data[c3] != 0x97)]
    low[c3] += 0x20
    row_start = np.zeros(len(data) + 1, bool)
    row_start[off] = True
    before = np.append(False, keep[:-1]) & ~row_start[:-1]
    take = keep | before  # the first separator after a word is its space
    low[~keep] = 0x20
    place = np.flatnonzero(take)
    text = low[place]
    bounds = np.searchsorted(place, off)
    last = bounds[1:] - 1
    trailing = last[(bounds[1:] > bounds[:-1])]
    trailing = trailing[text[trailing] == 0x20]
    if len(trailing):
        stay = np.ones(len(text), bool)
        stay[trailing] = False
        text, place = text[stay], place[stay]
        bounds = np.searchsorted(place, off)
    return text, bounds, place


def edit_distance(item: bytes, region: bytes) -> tuple[int, int]:
    """Least number of edits from item to a substring of region, and where the substring ends (bit-parallel)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(region):
        eq = peq.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(x | up)), up & x
        score += bool(plus & top) - bool(minus & top)
        if score < best:
            best, end = score, j + 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        carry = eq | down
        up, down = minus | (full & ~(carry | plus)), plus & carry
    return best, end


@dataclass
class Scan:
    """Pieces looked up in one way: whole (``size`` bytes), or windows of one byte more with each byte left out."""

    size: int
    edit: bool
    keys: np.ndarray  # sorted
    piece: np.ndarray
    seen: np.ndarray  # whether a key has this hash


@dataclass
class Groups:
    """Parts of items of at most as many bytes as a number has bits."""

    at: np.ndarray  # in the item
    size: np.ndarray
    most: np.ndarray  # edits
    equal: np.ndarray  # (groups, classes): bits where the group has a byte of the class
    of: np.ndarray  # group of each piece


@dataclass
class Items:
    """Reduced items with their pieces and groups."""

    ids: np.ndarray
    texts: list[bytes]
    piece_item: np.ndarray
    piece_at: np.ndarray
    scans: list[Scan]
    levels: list[Groups]
    classes: np.ndarray  # class of each byte; 0 for bytes of no item
    max_edits: float
    walks: list[Walks]


@dataclass
class Walks:
    """Walks of one length, the tables over them, and where item walks start."""

    stride: int  # of walks in texts
    turn: np.ndarray  # (functions, steps, 256): bytes to move on by
    picks: list[list[np.ndarray]]  # steps that the tables of each function sample
    item: np.ndarray  # of each start
    at: np.ndarray
    levels: list[Groups]
    keys: list[np.ndarray]  # of each table, sorted
    start: list[np.ndarray]  # of each key
    seen: list[np.ndarray]  # whether a key has this hash


def cut(size: int, edits: int) -> list[tuple[int, int, int]]:
    """(start, compared bytes, edits) of the pieces of an item: more than ``edits`` edits if each had one above its own."""
    if size // (edits + 1) >= WINDOW:
        return [(i * size // (edits + 1), WINDOW, 0) for i in range(edits + 1)]
    pairs, odd = divmod(edits + 1, 2)
    if not pairs:
        return [(0, size, 0)]
    length = max(1, min(WINDOW + 1, 2 * size // (edits + 1)))
    rest = max(min(WINDOW, size - length * pairs), 1) if odd else 0
    length = min(length, (size - rest) // pairs)
    return [(i * (size - rest) // pairs, length, 1) for i in range(pairs)] + ([(size - rest, rest, 0)] if odd else [])


def reduced(raw: list[str]) -> list[np.ndarray]:
    """The reduced bytes of each text."""
    data = [(t or "").encode() for t in raw]
    off = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    text, bounds, _ = normal(np.frombuffer(b"".join(data), np.uint8), off)
    return [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def make_groups(parts: list[tuple[bytes, int, int]], of: np.ndarray, classes: np.ndarray, kind: type) -> Groups:
    """Groups of (bytes, place in the item, edits)."""
    equal = np.zeros((len(parts), int(classes.max(initial=0)) + 1), kind)
    for g, (t, _, _) in enumerate(parts):
        for x, c in enumerate(t):
            equal[g, classes[c]] |= kind(1 << x)
    return Groups(np.array([x for _, x, _ in parts]), np.array([len(t) for t, _, _ in parts]), np.array([x for _, _, x in parts]), equal, of)


def build_items(ids: list[int], raw: list[str], max_edits: float, recall: float = 1.0) -> Items | None:
    """Index items by tables of the given recall, or by pieces for a recall of 1; None if there is none of LEAST_BYTES reduced bytes at least."""
    own = reduced(raw)
    keep = [i for i, t in enumerate(own) if len(t) >= LEAST_BYTES]
    if not keep:
        return None
    texts, numbers = [own[i].tobytes() for i in keep], np.array([ids[i] for i in keep], np.int64)
    classes = np.zeros(256, np.uint8)
    used = sorted(set(b"".join(texts)))
    classes[used] = np.arange(1, len(used) + 1)
    items = Items(numbers, texts, np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], classes, max_edits, [])
    short = [i for i, t in enumerate(texts) if recall >= 1 or len(t) < WALKS[-1][0]]
    most = MOST_TABLES if max_edits > 0 else SHARED
    for place, (least, *shape) in enumerate(WALKS):
        below = WALKS[place - 1][0] if place else 1 << 62
        mine = [i for i, t in enumerate(texts) if least <= len(t) < below]
        if recall >= 1 or not mine:
            continue
        for tables in range(min(LEAST_TABLES, most), most + 1, SHARED):
            items.walks.append(build_walks(texts, mine, classes, max_edits, tables, *shape))
            share = measured_recall(items, mine)
            if share >= recall:
                break
            items.walks.pop()
        else:
            short += mine
    return add_pieces(items, sorted(short)) if short else items


def build_walks(texts: list[bytes], mine: list[int], classes: np.ndarray, max_edits: float, tables: int, steps: int, sampled: int, stride: int) -> Walks:
    """Tables over the walks of some items."""
    rng = np.random.default_rng(steps)
    functions = -(-tables // SHARED)
    turn = rng.integers(0, 2, (functions, steps, 256)).astype(np.uint8)
    picks = [[np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(min(SHARED, tables - SHARED * f))] for f in range(functions)]
    item, at, begin = [], [], []
    parts: list[list[tuple[bytes, int, int]]] = [[], []]
    of: list[list[int]] = [[], []]
    base = 0
    for i in mine:
        t = texts[i]
        last = max(1, len(t) - steps // 2)
        own = np.arange(0, last, last // START_BYTES | 1)
        item.append(np.full(len(own), i))
        at.append(own)
        begin.append(own + base)
        base += len(t)
        allowed = int(max_edits * len(t))
        for level, bits in enumerate((32, 64)):
            first = np.clip(own // 8 * 8 - 8, 0, max(len(t) - bits, 0))
            places, which = np.unique(first, return_inverse=True)
            of[level].append(which + len(parts[level]))
            for a in places.tolist():
                size = min(bits, len(t) - a)
                # Edits that a part has seldom more of: the mean and two deviations.
                parts[level].append((t[a : a + size], a, min(allowed, int(np.ceil(size * max_edits + 2 * np.sqrt(size * max_edits * (1 - max_edits)))))))
    levels = [make_groups(parts[k], np.concatenate(of[k]), classes, kind) for k, kind in enumerate((np.uint32, np.uint64))]
    text = np.frombuffer(b"".join(texts[i] for i in mine) + bytes(steps + 1), np.uint8)
    made = Walks(stride, turn, picks, np.concatenate(item), np.concatenate(at), levels, [], [], [])
    for key in walk(made, text, np.concatenate(begin)):
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << min(24, max(16, len(key).bit_length() + 5)), bool)
        seen[_slot(key, len(seen))] = True
        made.keys.append(key[order])
        made.start.append(order)
        made.seen.append(seen)
    return made


def walk(walks: Walks, text: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of all tables, one array of them for each, at the given starts; text has padding for a walk."""
    multiply = np.uint64(0x9E3779B97F4A7C15)
    for turn, picks in zip(walks.turn, walks.picks):
        at = starts.astype(np.int64)
        keys = [np.zeros(len(at), np.uint64) for _ in picks]
        wanted = [set(p.tolist()) for p in picks]
        for step in range(len(turn)):
            symbol = np.take(text, at, mode="clip")
            for key, steps in zip(keys, wanted):
                if step in steps:
                    key *= multiply
                    key += symbol
            at += turn[step][symbol]
        yield from keys


def edited_copies(texts: list[bytes], max_edits: float) -> list[np.ndarray]:
    """Two copies of each text with all edits allowed: substitutions at even distances, and edits of all kinds anywhere."""
    rng = np.random.default_rng(len(texts))
    out = []
    for t in texts:
        letters = np.unique(np.frombuffer(t, np.uint8))
        edits = int(max_edits * len(t))
        even = np.frombuffer(t, np.uint8).copy()
        for k in range(edits):
            even[(2 * k + 1) * len(t) // (2 * edits)] = rng.choice(letters)
        some = list(t)
        for _ in range(edits):
            what, where, letter = rng.integers(3), int(rng.integers(max(len(some), 1))), int(rng.choice(letters))
            if what == 0:
                some.insert(where, letter)
            elif what == 1 and len(some) > 1:
                del some[where]
            else:
                some[where] = letter
        out += [even, np.array(some, np.uint8)]
    return out


def measured_recall(items: Items, mine: list[int]) -> float:
    """Share of the edited copies of up to MEASURED items that are found."""
    mine = [mine[k * len(mine) // min(len(mine), MEASURED)] for k in range(min(len(mine), MEASURED))]
    copies = edited_copies([items.texts[i] for i in mine], items.max_edits)
    text = np.concatenate([x for i, c in enumerate(copies) for x in (np.full(5 + i % 8, 0x20, np.uint8), c, np.full(3, 0x20, np.uint8))])
    sizes = np.array([len(c) + 8 + i % 8 for i, c in enumerate(copies)])
    found = {(r, i) for r, i, *_ in hits(items, text, np.concatenate([[0], np.cumsum(sizes)]))}
    return sum((k, mine[k // 2]) in found for k in range(len(copies))) / len(copies)


def add_pieces(items: Items, mine: list[int]) -> Items:
    """Index some items by pieces as well."""
    looked: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    piece_item, piece_at = [], []
    made: list[list[tuple[bytes, int, int]]] = [[], []]  # text, start and edits of the groups of both levels
    of: list[list[int]] = [[], []]
    for i in mine:
        t = items.texts[i]
        pieces_here = cut(len(t), int(items.max_edits * len(t)))
        n = len(pieces_here)
        small = max(1, n // 2)
        large = max(1, min(small, -(-len(t) // 64)))
        low = [x * small // n for x in range(n)]
        for level, bits, group in ((0, 32, low), (1, 64, [g * large // small for g in low])):
            first = np.searchsorted(group, np.arange(group[-1] + 2)).tolist()
            for a, b in zip(first[:-1], first[1:]):
                start, end = pieces_here[a][0], pieces_here[b][0] if b < n else len(t)
                made[level].append((t[start : min(end, start + bits)], start, sum(edit + 1 for _, _, edit in pieces_here[a:b]) - 1))
            of[level] += [len(made[level]) - group[-1] - 1 + g for g in group]
        spread = {length - 1 for _, length, edit in pieces_here if edit}
        for start, length, edit in pieces_here:
            p = t[start : start + length]
            shorter = {p[:j] + p[j + 1 :] for j in range(length)} if edit else {p}
            looked.setdefault((length - edit, length - edit in spread), []).extend((int.from_bytes(x, "little"), len(piece_item)) for x in shorter)
            piece_item.append(i)
            piece_at.append(start)
    for (size, edit), pairs in sorted(looked.items()):
        key, piece = np.array([k for k, _ in pairs], np.uint64), np.array([x for _, x in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << min(24, max(16, len(key).bit_length() + 5)), bool)
        seen[_slot(key, len(seen))] = True
        items.scans.append(Scan(size, edit, key[order], piece[order], seen))
    items.levels = [make_groups(groups, np.array(which), items.classes, kind) for groups, which, kind in zip(made, of, (np.uint32, np.uint64))]
    items.piece_item, items.piece_at = np.array(piece_item), np.array(piece_at)
    return items


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).view(np.int64)


def seeds(scan: Scan, words: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) where a window equals a piece, from the numbers at each byte and the byte after."""
    mask = [np.uint64((1 << 8 * j) - 1) for j in range(9)]
    a, b = words & mask[scan.size], after & mask[scan.size]
    differ = a ^ b
    where, what = [], []
    for j in range(1, scan.size + 1) if scan.edit else (scan.size,):  # without its first byte a window is the next one without its last
        key = a if j == scan.size else b ^ (differ & mask[j])
        at, k = equal_keys(scan.keys, scan.seen, key)
        where.append(at)
        what.append(scan.piece[k])
    return np.concatenate(where), np.concatenate(what)


def within(groups: Groups, group: np.ndarray, start: np.ndarray, slack: int, text: np.ndarray) -> np.ndarray:
    """Whether a group has a substring within its edits in text about start; text is of classes, with 256 bytes before and after."""
    kind, width = groups.equal.dtype.type, groups.equal.shape[1]
    out = np.zeros(len(group), bool)
    flat = groups.equal.ravel()
    one = kind(1)
    for s in range(0, len(group), LANES):
        g = group[s : s + LANES]
        size, most = groups.size[g], groups.most[g]
        row, place = g * width, start[s : s + LANES] - most - slack + 256
        steps = int((size + 2 * (most + slack)).max())
        place = np.clip(place, 0, len(text) - steps)  # beyond the padding there is no passage
        last = (size - 1).astype(kind)
        up, down = np.full(len(g), ~kind(0)), np.zeros(len(g), kind)
        score = size.astype(np.int16)
        best = score.copy()
        for step in range(steps):
            eq = flat[row + text[place + step]]
            x = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(x | up), up & x
            score += ((plus >> last) & one).astype(np.int16)
            score -= ((minus >> last) & one).astype(np.int16)
            np.minimum(best, score, out=best)
            plus, minus = plus << one, minus << one
            carry = eq | down
            up, down = minus | ~(carry | plus), plus & carry
        out[s : s + LANES] = best <= most
    return out


def equal_keys(keys: np.ndarray, seen: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in own, place in sorted keys) of all equal pairs."""
    at = np.flatnonzero(seen[_slot(own, len(seen))])
    key = own[at]
    first = np.searchsorted(keys, key, "left")
    same = keys[np.minimum(first, len(keys) - 1)] == key
    at, first, key = at[same], first[same], key[same]
    count = np.searchsorted(keys, key, "right") - first
    k = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return np.repeat(at, count), k


def collisions(walks: Walks, padded: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, start) of text walks from first to end that equal an item walk in some table, one for each part and alignment."""
    starts = np.arange(-(-first // walks.stride) * walks.stride, end, walks.stride)
    where, what = [], []
    for number, key in enumerate(walk(walks, padded, starts)):
        at, k = equal_keys(walks.keys[number], walks.seen[number], key)
        where.append(starts[at])
        what.append(walks.start[number][k])
    at, start = np.concatenate(where), np.concatenate(what)
    group, aligned = walks.levels[0].of[start], (at - walks.at[start] - first + (1 << 40)) // 8
    order = np.lexsort((aligned, group))
    new = np.append(True, (np.diff(group[order]) != 0) | (np.diff(aligned[order]) != 0))[: len(order)]
    return at[order[new]], start[order[new]]


def hits(items: Items, text: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item index, start, end, edits) in reduced text of each item found, the best place of each."""
    n = len(text)
    if not n:
        return []
    longest = max([WINDOW, *(len(w.turn[0]) for w in items.walks)])
    padded = np.concatenate([text, np.zeros(longest + 1, np.uint8)])
    classed = np.concatenate([np.zeros(256, np.uint8), items.classes[text], np.zeros(512, np.uint8)])
    found = []
    for a in range(0, n, STRETCH):
        size = min(STRETCH, n - a)
        for walks in items.walks:
            at, start = collisions(walks, padded, a, a + size)
            for level in walks.levels:
                near = within(level, level.of[start], at - walks.at[start] + level.at[level.of[start]], 3, classed)
                start, at = start[near], at[near]
            found.append((row_of(bounds, np.minimum(at, n - 1)), walks.item[start], at - walks.at[start]))
        if not items.scans:
            continue
        words = np.ndarray((size + 1,), "<u8", padded, a, (1,)).copy()
        for scan in items.scans:
            at, piece = seeds(scan, words[:-1], words[1:])
            if not len(at):
                continue
            code = np.unique(piece * (STRETCH // 2) + at // 2)  # one for two neighbouring windows
            piece, at = code // (STRETCH // 2), code % (STRETCH // 2) * 2 + a
            for level in items.levels:
                near = within(level, level.of[piece], at - items.piece_at[piece] + level.at[level.of[piece]], 3, classed)
                piece, at = piece[near], at[near]
            found.append((row_of(bounds, np.minimum(at + 1, n - 1)), items.piece_item[piece], at - items.piece_at[piece]))
    if not found:
        return []
    places: dict[tuple[int, int], list[int]] = {}
    for r, i, p in zip(*(np.concatenate(x).tolist() for x in zip(*found))):
        places.setdefault((r, i), []).append(p)
    best = []
    for (r, i), starts in sorted(places.items()):
        word = items.texts[i]
        most = int(items.max_edits * len(word))
        least, begin, stop = most + 1, 0, 0
        first = int(bounds[r])
        end = int(bounds[r + 1])
        stretches: list[list[int]] = []
        for p in sorted(set(starts)):
            low, high = max(first, p - most - 3), min(end, p + len(word) + most + 3)
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = max(high, stretches[-1][1])
            else:
                stretches.append([low, high])
        for low, high in stretches:
            region = text[low:high].tobytes()
            place = region.find(word)
            edits, last = (0, place + len(word)) if place >= 0 else edit_distance(word, region)
            if edits < least:
                least, begin, stop = edits, max(low, low + last - len(word)), low + last
            if not edits:
                break
        if least <= most:
            best.append((r, i, begin, stop, least))
    return best


def item_passes(items: DataFrame, max_edits: float, recall: float, item_col: str, item_text: str) -> list[Broadcast]:
    """Indexes of bounded size that hold all items, each on all executors."""
    spark = prepare(items.sparkSession)
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    held = known.agg(F.sum(F.least(F.octet_length("t"), F.lit(2 * START_BYTES)))).first()[0] or 0
    passes = max(1, -(-held // PASS_BYTES), -(-known.count() // ITEMS_PER_PASS))
    out = []
    for number in range(passes):
        block = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == number).orderBy("i", "t").toArrow()  # about PASS_BYTES
        out.append(spark.sparkContext.broadcast(build_items(block.column(0).to_pylist(), block.column(1).to_pylist(), max_edits, recall)))
    return out


def without_items(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, recall: float = 0.99, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in which find_items() finds nothing, with all their columns; every pass filters rows where they are."""
    schema = docs.schema
    for sent in item_passes(items, max_edits, recall, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, off in pieces(batch, text_col, 1 << 20):
                    clean = np.ones(part.num_rows, bool)
                    if sent.value is not None:
                        text, bounds, _ = normal(data, off)
                        clean[[r for r, *_ in hits(sent.value, text, bounds)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs


def find_items(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: contaminated, n_items, item_ids (ascending), similarity (of the best, 0 if none) and hits.

    An item is found where a substring is within ``max_edits`` edits a byte of the
    item's length and a table leads to it: at least a share of ``recall`` of edited copies of the items, and
    every exact one.  What is found is verified.  ``hits`` holds item, byte start and end in the text, and edits, for the
    best place of each item.  Items of fewer than ten bytes of reduced text (in any
    script, with or without spaces), null texts and empty tables find nothing.  Repeated rows each have a row; other columns are left out.
    No shuffle in one pass; more items than PASS_BYTES hold take further passes over the rows,
    which are numbered and stored first, and results are joined by that number.
    """
    spark = prepare(docs.sparkSession)
    indexes = item_passes(items, max_edits, recall, item_col, item_text)
    passes = len(indexes)
    rows = docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id() if passes > 1 else F.lit(0).cast("long"))
    if passes > 1:  # stored, so that every pass sees the same numbers
        rows = write_table(rows, shared_dir(spark), "rows")
    schema = f"_row long, {id_col} long, contaminated boolean, n_items long, item_ids array<long>, similarity double, hits array<struct<item_id: long, start: long, end: long, edits: long>>"
    out = None
    for sent in indexes:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part, data, off in pieces(batch, text_col, 1 << 20):
                    n = part.num_rows
                    rows: list[list[dict]] = [[] for _ in range(n)]
                    best = [0.0] * n
                    if index is not None:
                        text, bounds, place = normal(data, off)
                        for r, i, a, b, edits in hits(index, text, bounds):
                            rows[r].append({"item_id": int(index.ids[i]), "start": int(place[a] - off[r]), "end": int(place[b - 1] + 1 - off[r]), "edits": edits})
                            best[r] = max(best[r], 1 - edits / len(index.texts[i]))
                    ids = [sorted({h["item_id"] for h in x}) for x in rows]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_row"), part.column(id_col).cast(pa.int64()), pa.array([bool(x) for x in ids]), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64()), pa.array([sorted(x, key=lambda h: (h["item_id"], h["start"])) for x in rows], pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "edits")])))],
                        ["_row", id_col, "contaminated", "n_items", "item_ids", "similarity", "hits"],
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if passes > 1:
        hits_in_order = F.array_sort(F.flatten(F.collect_list("hits")))
        out = out.groupBy("_row").agg(F.first(id_col).alias(id_col), F.max("contaminated").alias("contaminated"), F.array_distinct(F.array_sort(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("similarity").alias("similarity"), hits_in_order.alias("hits"))
        out = out.withColumn("n_items", F.size("item_ids").cast("long")).select("_row", id_col, "contaminated", "n_items", "item_ids", "similarity", "hits")
    return out.drop("_row")
