"""Exact batch tokenization with public vocabularies, one distinct word at a time.

Both tokenizers cut a text into segments that never influence each other, so the
ids of a segment are found once per process and reused.  Texts with anything the
quick segmentation does not model go to the library itself, whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from ._bpe import PairTable, merge_all
from ._prefixes import SPACE, PrefixProgram
from ._text import SegmentCache, prefix_hash, range_hash, row_of

#: Segments longer than this are encoded by the library and not kept.
LONGEST_KEPT = 96

_OTHER, _SPACE, _LETTER, _NUMBER, _ODD = range(5)


def _code_point_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the code points below U+0180 (two UTF-8 bytes)."""
    kind = np.full(0x180, _ODD, np.uint8)
    low = np.arange(0x180, dtype=np.uint16)
    for cp in range(0x180):
        c, cat = chr(cp), unicodedata.category(chr(cp))
        if cp in (9, 10, 11, 12, 13, 32, 0xA0):
            kind[cp] = _SPACE
        elif cat[0] == "L":
            kind[cp] = _LETTER
        elif cat[0] == "N":
            kind[cp] = _NUMBER
        elif cat[0] in "PS":
            kind[cp] = _OTHER
        if len(c.lower()) == 1 and ord(c.lower()) < 0x180:
            low[cp] = ord(c.lower())
        else:
            kind[cp] = _ODD
    return kind, low


_KIND, _LOW = _code_point_classes()
_ASCII_KIND = np.concatenate([_KIND[:128], np.full(128, _ODD, np.uint8)])
_ASCII_LOW = np.concatenate([_LOW[:128].astype(np.uint8), np.arange(128, 256, dtype=np.uint8)])


class WordTokenizer:
    """Lower-casing word BPE with an end-of-word mark, from a tokenizer JSON."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        model = json.loads(spec)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([vocab[name[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[name[b] + suffix] for b in range(256)], np.int32)
        self.cache = SegmentCache(self._merge)

    def _merge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(lengths) - 1
        sym[last] = self.final[raw[last]]
        return merge_all(sym, lengths, self.table)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each text has."""
        n = len(off) - 1
        kind, low = _ASCII_KIND[data], _ASCII_LOW[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
        if len(lead):
            cp = (data[lead].astype(np.int32) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
            kind[lead] = kind[lead + 1] = _KIND[cp]
            lc = _LOW[cp]
            low[lead], low[lead + 1] = 0xC0 | (lc >> 6), 0x80 | (lc & 0x3F)
            ascii_now = lead[lc < 128]
            kind[ascii_now] = kind[ascii_now + 1] = _ODD
        odd = kind == _ODD
        bar = np.flatnonzero(data == ord("|"))
        odd[bar[(bar > 0) & (data[np.maximum(bar - 1, 0)] == ord("<"))]] = True
        strange = np.unique(row_of(off, np.flatnonzero(odd)))
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == _NUMBER) & ((data[1:] & 0xC0) != 0x80))
        edge[off[off < len(data)]] = True
        at = np.flatnonzero(edge)[:-1]
        at, extra = self._contractions(data, low, kind, off, edge, at)
        end = np.append(at[1:], len(data)) if len(at) else at
        keep = kind[at] != _SPACE
        at, end = at[keep], end[keep]
        row = row_of(off, at)
        if len(strange):
            keep = ~np.isin(row, strange)
            at, end, row = at[keep], end[keep], row[keep]
        running = prefix_hash(low)
        key = range_hash(running, at, end)
        long = end - at > LONGEST_KEPT
        if long.any():
            where = np.flatnonzero(long)
            mine, sizes = self._merge([low[a:b].tobytes() for a, b in zip(at[where], end[where])])
        first, count = self.cache.lookup(key[~long], low, at[~long], end[~long])
        counts = np.zeros(len(at), np.int64)
        counts[~long] = count
        if long.any():
            counts[where] = sizes
        ids = np.empty(int(counts.sum()), np.int32)
        if long.any():
            into = np.repeat(long, counts)
            ids[~into], ids[into] = self.cache.gather(first, count), mine
        else:
            ids = self.cache.gather(first, count)
        per_row = np.bincount(row, weights=counts, minlength=n).astype(np.int64)
        if not len(strange):
            return ids, per_row
        found = self.library.encode_batch([data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in strange], add_special_tokens=False)
        ends = np.cumsum(per_row)
        parts, done = [], 0
        for r, e in zip(strange.tolist(), found):
            parts += [ids[done : ends[r]], np.asarray(e.ids, np.int32)]
            done = ends[r]
            per_row[r] = len(e.ids)
        return np.concatenate([*parts, ids[done:]]), per_row

    @staticmethod
    def _contractions(data, low, kind, off, edge, at):
        """Split ``'s 't 'm 'd 're 've 'll`` off where an apostrophe begins a run."""
        q = at[low[at] == 0x27]
        q = q[(q + 1 < len(data))]
        if not len(q):
            return at, 0
        row_end = off[1:][row_of(off, q)]
        a = np.where(q + 1 < row_end, low[np.minimum(q + 1, len(low) - 1)], 0)
        b = np.where(q + 2 < row_end, low[np.minimum(q + 2, len(low) - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = one | two
        q, size = q[hit], np.where(one, 2, 3)[hit]
        edge[q + 1] = False
        edge[q + size] = True
        return np.flatnonzero(edge)[:-1], len(q)


class PieceCounter:
    """Token counts of a sentencepiece BPE model at every prefix, by space-led segments.

    No piece of such a model has a space mark after another character, so no merge
    crosses the start of a run of spaces and counts add up over segments.  A segment's
    own prefixes are counted by PrefixProgram, once for all texts.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        inner = re.compile("[^\u2581]\u2581")
        self.splits = not any(inner.search(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size()))
        self.program = PrefixProgram(self.library)
        self.cache = SegmentCache(self._segments)

    def text_prefixes(self, text: str) -> list[int]:
        """Tokens of the prefixes of one whole text, of one character or more."""
        got = self.program.counts(SPACE + text.replace(" ", SPACE)) if "\0" not in text else None
        if got is not None and got[-1:] == [max(len(self.library.encode(text)), int(not text))]:
            return got[1:]
        return [len(x) for x in self._encoded([text[:p] for p in range(1, len(text) + 1)])]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """About a million characters at once."""
        out, step = [], max(1, 1_000_000 // max(max(map(len, texts), default=1), 1))
        for k in range(0, len(texts), step):
            out += self.library.encode(texts[k : k + step], num_threads=1)
        return out

    def _segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at each character of each segment (its first space included), and how many; the library agrees on the last."""
        words = [t[1:].decode("utf-8", "replace") for t in texts]
        # A lone space is its mark; without the model's own space nothing is left to encode.
        totals = [max(len(x), 1) for x in self._encoded(words)]
        found: list[list[int]] = [[]] * len(words)
        for k in sorted(range(len(words)), key=words.__getitem__):
            got = self.program.counts(SPACE + words[k].replace(" ", SPACE))
            if got is None or got[-1] != totals[k]:
                got = [1, *(len(x) for x in self._encoded([words[k][:p] for p in range(1, len(words[k]) + 1)]))]
            found[k] = got
        return np.fromiter((c for x in found for c in x), np.int64), np.fromiter(map(len, found), np.int64, len(found))

    def segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text with a space before each row, and each segment's start, end and row in it."""
        n = len(off) - 1
        own = np.full(len(data) + n, 0x20, np.uint8)
        mark = np.ones(len(own), bool)
        first = off[:-1] + np.arange(n)
        mark[first] = False
        own[mark] = data
        space = own == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[first] = True
        at = np.flatnonzero(start)
        return own, at, np.append(at[1:], len(own)), row_of(np.append(first, len(own)), at)

    def prefix_totals(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same table as (byte end in the row, tokens up to there, row) of each character."""
        counts, ends, bounds = self.prefix_table(data, off)
        return ends, counts, np.repeat(np.arange(len(off) - 1), np.diff(bounds))

    def prefix_table(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens up to each character, the byte end of each character in its row, and row bounds of both.

        The count at a character is the total of the segments before plus the count in
        its own.  Rows that the segmentation does not model (a literal space mark or a NUL)
        go through the program, or the library, whole.
        """
        n = len(off) - 1
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        bounds = np.searchsorted(starts, off)
        row_of_char = np.repeat(np.arange(n), np.diff(bounds))
        ends = np.append(starts[1:], len(data)) - off[row_of_char] if len(starts) else starts
        if not self.splits:
            strange = np.flatnonzero(off[1:] > off[:-1])
        else:
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
            strange = np.unique(row_of(off, np.sort(np.concatenate([mark, np.flatnonzero(data == 0)]))))
        own, at, end, row = self.segments(data, off)
        skip = off[1:] == off[:-1]
        skip[strange] = True
        keep = ~skip[row]
        at, end, row = at[keep], end[keep], row[keep]
        counts = np.zeros(len(starts), np.int64)
        if len(at):
            long = end - at > LONGEST_KEPT
            key = range_hash(prefix_hash(own), at, end)
            sizes, parts = np.zeros(len(at), np.int64), {}
            first, sizes[~long] = self.cache.lookup(key[~long], own, at[~long], end[~long])
            for k in np.flatnonzero(long).tolist():
                parts[k], (sizes[k],) = self._segments([own[at[k] : end[k]].tobytes()])
            inside = np.zeros(int(sizes.sum()), np.int64)
            into = np.repeat(long, sizes)
            inside[~into] = self.cache.gather(first, sizes[~long])
            if parts:
                inside[into] = np.concatenate([parts[k] for k in sorted(parts)])
            stop = np.cumsum(sizes)
            total = inside[stop - 1]
            run = np.cumsum(total)
            new = np.append(True, row[1:] != row[:-1])
            before = run - total - np.repeat((run - total)[new], np.diff(np.append(np.flatnonzero(new), len(row))))
            inside += np.repeat(before, sizes)
            real = np.ones(len(inside), bool)
            real[(stop - sizes)[new]] = False  # the space that the model puts before a text
            counts[~skip[row_of_char]] = inside[real]
        for r in strange.tolist():
            text = data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
            counts[bounds[r] : bounds[r + 1]] = self.text_prefixes(text)
        return counts, ends, bounds
