"""Token counts at prefixes, by dynamic programming over independent segments."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import prepare
from ._text import pieces
from ._tokenizers import PieceCounter

_counters: dict[int, PieceCounter] = {}


def counter(model: bytes) -> PieceCounter:
    """This process's counter for a model, with the segments it has seen."""
    key = hash(model)
    if key not in _counters:
        _counters[key] = PieceCounter(model)
    return _counters[key]


class PrefixTable:
    """Exact token count at every prefix of one text, for a sentencepiece BPE model.

    ``count[p]`` is the number of tokens of the first ``p`` characters.  Empty text: one
    entry, 0.
    """

    def __init__(self, text: str | None, model: bytes):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        self.count = [0, *counter(model).prefix_table(raw, np.array([0, len(raw)]))[0].tolist()]

    def tokens(self, prefix: int | None = None) -> int:
        """Tokens of the first ``prefix`` characters (all, if none is given)."""
        return self.count[-1 if prefix is None else prefix]

    def longest_within(self, budget: int) -> int:
        """The longest prefix, in characters, of at most ``budget`` tokens."""
        return max(p for p, c in enumerate(self.count) if c <= budget)


def prefix_totals(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """One row per input row: bytes, tokens, whether they exceed ``limit``, and where to cut the text so that they do not.

    Tokens are those of the sentencepiece library without begin or end marks; null
    and empty texts have none.  All answers are read off the table of counts at every
    prefix: ``n_tokens`` is the last one, ``cut_bytes`` the end of the longest prefix of
    whole characters of at most ``limit`` tokens, and ``cut_tokens`` its tokens.  With
    ``keep_prefixes`` two more columns store the table, in runs of prefixes with equal
    counts: ``prefix_end`` (byte end of the last of each run) and ``prefix_tokens``, from
    which truncation (``tokens_at``) and budget questions (``fits``) are answered exactly.
    Repeated rows each have their own row; columns besides id and text are left out,
    so their names cannot clash.  Memory is bounded by the longest text; no shuffle.
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    schema = f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long, cut_tokens long" + ", prefix_end array<long>, prefix_tokens array<long>" * keep_prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value)
        for batch in batches:
            for part, data, off in pieces(batch, text_col, 1 << 20):
                tokens, ends, bounds = count.prefix_table(data, off)
                n = part.num_rows
                last = np.zeros(n, np.int64)
                some = bounds[1:] > bounds[:-1]
                last[some] = tokens[bounds[1:][some] - 1]
                cut_bytes, cut_tokens = np.diff(off), last.copy()
                for r in np.flatnonzero(last > limit).tolist():
                    within = np.flatnonzero(tokens[bounds[r] : bounds[r + 1]] <= limit)
                    k = bounds[r] + within[-1] if len(within) else -1
                    cut_bytes[r], cut_tokens[r] = (ends[k], tokens[k]) if k >= 0 else (0, 0)
                out = [part.column(id_col).cast(pa.int64()), pa.array(np.diff(off)), pa.array(last), pa.array(last > limit), pa.array(cut_bytes), pa.array(cut_tokens)]
                names = [id_col, "n_bytes", "n_tokens", "over_limit", "cut_bytes", "cut_tokens"]
                if keep_prefixes:
                    final = np.append(tokens[1:] != tokens[:-1], True) if len(tokens) else np.zeros(0, bool)
                    final[bounds[1:][some] - 1] = True
                    at = np.flatnonzero(final)
                    lists = pa.array(np.searchsorted(at, bounds).astype(np.int32))
                    out += [pa.ListArray.from_arrays(lists, pa.array(x[at])) for x in (ends, tokens)]
                    names += ["prefix_end", "prefix_tokens"]
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def fits(prefix_end: list[int], prefix_tokens: list[int], budget: int) -> int:
    """The byte end of the longest prefix of whole characters of at most ``budget`` tokens (0: none); counts can fall, so the last one is sought."""
    return next((e for e, c in zip(reversed(prefix_end), reversed(prefix_tokens)) if c <= budget), 0)


def tokens_at(prefix_end: list[int], prefix_tokens: list[int], end: int) -> int:
    """Tokens of the prefix of ``end`` bytes, which end with a character."""
    return prefix_tokens[bisect_left(prefix_end, end)] if end else 0
