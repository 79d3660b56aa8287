"""Language identification of whole texts, with spans of mixed-language text.

Words are runs of letters of one script.  The script leaves only the languages whose
training text uses it; among these a word is scored by its byte trigrams, and a
Viterbi path over all words, with a penalty for switching, labels spans.  A
document's language is the one that labels most bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare
from ._text import flat, pieces, row_of

UNKNOWN = "und"
#: log2 of the number of trigram slots.
SLOT_BITS = 17
BLOCK = 64
# First code points of script ranges, in order, with a script number each (1 Latin, 0 other).
SCRIPT_STARTS = (0x0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFF00, 0x10000)
SCRIPTS = (1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 0, 10, 11, 12, 1, 2, 0, 13, 14, 14, 0, 11, 0, 14, 6, 1, 0)
_LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)), bool, 0x10000)


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of UTF-8: whether it belongs to a letter, and the letter's script."""
    cp = data.astype(np.int32)
    lead = np.flatnonzero(data >= 0xC2)
    at = lambda k: (data[np.minimum(lead + k, len(data) - 1)] & 0x3F).astype(np.int32)
    b = data[lead].astype(np.int32)
    two, three = (b & 0x1F) << 6 | at(1), (b & 0x0F) << 12 | at(1) << 6 | at(2)
    four = (b & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)
    code = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
    cp[lead] = code
    wide = np.flatnonzero(cp > 0xFFFF)
    is_letter = _LETTER[np.minimum(cp, 0xFFFF)]
    if len(wide):
        is_letter[wide] = [unicodedata.category(chr(min(c, 0x10FFFF)))[0] == "L" for c in cp[wide].tolist()]
    script = np.asarray(SCRIPTS, np.uint8)[np.searchsorted(SCRIPT_STARTS, cp, "right") - 1] if len(lead) else np.ones(len(data), np.uint8)
    for k in range(1, 4):  # later bytes follow their lead
        more = lead[b >= (0, 0xC2, 0xE0, 0xF0)[k]] + k
        more = more[more < len(data)]
        is_letter[more], script[more] = is_letter[more - k], script[more - k]
    return is_letter, script


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and script of each word, and the lower-case bytes."""
    low = _LOW[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)  # capitals of U+00C0..U+00DE
    c3 = c3[(data[c3] >= 0x80) & (data[c3] <= 0x9E) & (data[c3] != 0x97)]
    low[c3] += 0x20
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, z, low
    letter, script = letters(data)
    kind = np.where(letter, script + 1, 0).astype(np.uint8)
    edge = np.zeros(len(data), bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    edge[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(data))
    keep = kind[at] > 0
    at, end = at[keep], end[keep]
    return at, end, row_of(off, at), (kind[at] - 1).astype(np.int64), low


def trigram_slots(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the trigram around each byte of each word (a space beside its ends), on end; and word bounds there."""
    inside = np.zeros(len(low) + 2, np.uint8)
    inside[1:-1] = low
    mark = np.zeros(len(low) + 1, np.int8)
    mark[start] += 1
    np.subtract.at(mark, end, 1)
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    a, b, c = inside[at].astype(np.uint32), inside[at + 1].astype(np.uint32), inside[at + 2].astype(np.uint32)
    sizes = end - start
    last = np.cumsum(sizes)
    a[last - sizes] = 0x20
    c[last - 1] = 0x20
    code = (a << np.uint32(16)) | (b << np.uint32(8)) | c
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int32), last - sizes


@dataclass(frozen=True)
class LanguageModel:
    """Log weights of trigram slots per language, and the scripts each language uses."""

    languages: tuple[str, ...]
    weights: np.ndarray  # (languages, slots)
    allowed: np.ndarray  # (scripts, languages)
    switch: float = 12.0


def fit(train: DataFrame, rows_per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch: float = 12.0) -> LanguageModel:
    """Learn from about ``rows_per_language`` whole documents of each language (all, if fewer).

    Which rows are taken depends on the hash of the id alone.  Rows with a null text
    or label do not count.  Without rows the model knows no language.
    """
    spark = prepare(train.sparkSession)
    known = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row per language
    names = tuple(sorted(counts))
    scripts, slots = max(SCRIPTS) + 1, 1 << SLOT_BITS
    tally, seen = np.zeros((len(names), slots)), np.zeros((scripts, len(names)))
    if names:
        share = F.create_map([F.lit(x) for n in names for x in (n, rows_per_language / counts[n])])
        taken = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < F.element_at(share, F.col(lang_col)) * 1_000_003)
        for table in (taken.select(text_col, lang_col).toArrow(),):
            label = np.array([names.index(x) for x in table.column(1).to_pylist()], np.int64)
            for first in range(0, table.num_rows, 200):
                part = table.slice(first, 200)
                data, off = flat(part.column(0))
                at, end, row, script, low = words(data, off)
                slot, _ = trigram_slots(low, at, end)
                who = label[first + row]
                np.add.at(seen, (script, who), end - at)
                tally += np.bincount(np.repeat(who, end - at) * slots + slot, minlength=tally.size).reshape(tally.shape)
    smooth = (tally + 0.3) / (tally.sum(1, keepdims=True) + 0.3 * slots)
    share_of_script = seen / np.maximum(seen.sum(0, keepdims=True), 1)
    return LanguageModel(names, np.log(smooth).astype(np.float32), share_of_script >= 0.01, switch)


def emissions(model: LanguageModel, at: np.ndarray, end: np.ndarray, script: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Score of each word in each language, 0 for the best; languages that do not use its script are far behind."""
    slot, first = trigram_slots(low, at, end)
    out = np.empty((len(at), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        out[:, k] = np.add.reduceat(model.weights[k][slot], first)
    allowed = model.allowed[script]
    some = allowed.any(1)
    out[~some] = 0
    out[some[:, None] & ~allowed] -= 1e4
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -40.0)


def viterbi(emit: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Best path per row under a constant switching penalty; ties to the lower state.

    Blocks of words are reduced to max-plus matrices in step with one another, the
    matrices are chained along each row, and paths are traced back the same way.
    """
    n, k = emit.shape
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(first, n))
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(first)), blocks)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[owner] + order * BLOCK
    width = np.minimum(BLOCK, first[owner] + size[owner] - begin)
    steps = int(width.max())
    nb = len(owner)
    padded = np.zeros((steps, nb, k), np.float32)
    for t in range(steps):
        on = width > t
        padded[t, on] = emit[begin[on] + t]
    gain = np.full((nb, k, k), -1e9, np.float32)
    gain[:, np.arange(k), np.arange(k)] = 0
    for t in range(steps):
        np.maximum(gain, gain.max(2, keepdims=True) - penalty, out=gain)
        gain += padded[t][:, None, :]
    start = np.zeros((nb, k), np.float32)
    state = np.zeros((len(first), k), np.float32)
    at_block = np.cumsum(blocks) - blocks
    for s in range(int(blocks.max())):
        on = np.flatnonzero(blocks > s)
        b = at_block[on] + s
        start[b] = state[on] - state[on].max(1, keepdims=True)
        state[on] = (start[b][:, :, None] + gain[b]).max(1)
    end_state, begin_state = np.zeros(nb, np.int64), np.zeros(nb, np.int64)
    current = state.argmax(1)
    for s in range(int(blocks.max()) - 1, -1, -1):
        on = np.flatnonzero(blocks > s)
        b = at_block[on] + s
        end_state[b] = current[on]
        begin_state[b] = (start[b] + gain[b, :, current[on]]).argmax(1)
        current[on] = begin_state[b]
    v = np.full((nb, k), -1e9, np.float32)
    v[np.arange(nb), begin_state] = 0
    jumped = np.zeros((steps, nb, k), bool)
    source = np.zeros((steps, nb), np.int64)
    for t in range(steps):
        source[t] = v.argmax(1)
        other = v.max(1, keepdims=True) - penalty
        jumped[t] = other > v
        v = np.maximum(v, other) + padded[t]
    path = np.zeros((steps, nb), np.int64)
    now = end_state
    for t in range(steps - 1, -1, -1):
        path[t] = now
        now = np.where(jumped[t, np.arange(nb), now], source[t], now)
    t = np.arange(n) - np.repeat(begin, width)
    return path[t, np.repeat(np.arange(nb), width)]


def predictions(batches: Iterator[pa.RecordBatch], m: LanguageModel, text_col: str) -> Iterator[tuple]:
    """(rows, row offsets, best language of each, its share, words as (start, end, row, language)) of runs of rows."""
    k = len(m.languages)
    for batch in batches:
        for part, data, off in pieces(batch, text_col, 1 << 20):
            n = part.num_rows
            at, end, row, script, low = words(data, off)
            if not k:
                at, end, row, script = at[:0], end[:0], row[:0], script[:0]
            path = viterbi(emissions(m, at, end, script, low), row, m.switch) if len(at) else np.zeros(0, np.int64)
            mass = np.bincount(row * max(k, 1) + path, weights=end - at, minlength=n * max(k, 1)).reshape(n, -1)
            total = mass.sum(1)
            best = np.where(total > 0, mass.argmax(1), k)
            yield part, off, best, np.where(total > 0, mass.max(1) / np.maximum(total, 1), 0.0), (at, end, row, path)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per input row: lang_pred, score (share of word bytes in that language), and with ``spans`` the labelled spans (byte start, end, lang).

    A null text or one without letters is ``und`` with score 0; so is every text if
    the model knows no language.  Languages with equal bytes: the first by name.
    Repeated rows each have a row; other columns are left out.  No shuffle; memory is
    bounded by the longest text.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    schema = f"{id_col} long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, UNKNOWN], object)
        for part, off, best, score, (at, end, row, path) in predictions(batches, sent.value, text_col):
            out = [part.column(id_col).cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score)]
            fields = [id_col, "lang_pred", "score"]
            if spans:
                new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (row[1:] != row[:-1]))) if len(path) else np.zeros(0, np.int64)
                stop = end[np.append(new[1:], len(path)) - 1] if len(new) else new
                base = off[row[new]]
                parts = [pa.array(at[new] - base), pa.array(stop - base), pa.array(names[path[new]], pa.string())]
                bounds = np.searchsorted(row[new], np.arange(part.num_rows + 1)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, ["start", "end", "lang"])))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(out, fields)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose text identify() does not call ``und``, with all their columns; rows are judged where they are."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, _, _ in predictions(batches, sent.value, text_col):
            yield part.filter(pa.array(best < len(sent.value.languages)))

    return docs.mapInArrow(run, docs.schema)
