"""Static pruning: which elements of a vector, query or posting list are kept.

Rows are (group, tie-break key, ``weight``).  Every rank and running sum has a total
order (weight descending, then key), so results do not depend on partitioning.
Rules that differ in strictness or precision are separate functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.quantize import wrap_int8
from .sizes import BROADCAST_ROWS, bounded_broadcast, is_small


def _f(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _order(by: str, tie: str, signed: bool = False):
    return Window.partitionBy(by).orderBy((F.col("weight") if signed else F.abs("weight")).desc(), F.col(tie))


def mass_exclusive(df: DataFrame, by: str, tie: str, alpha: float) -> DataFrame:
    """Keep the elements before the running mass exceeds alpha of the total; may keep none."""
    if not 0 < alpha < 1:
        return df
    w = F.abs("weight")
    run, total = F.sum(w).over(_order(by, tie).rowsBetween(Window.unboundedPreceding, 0)), F.sum(w).over(Window.partitionBy(by))
    return df.withColumn("_c", run).withColumn("_s", total).where(_f(F.col("_c")) <= _f(alpha) * _f(F.col("_s"))).drop("_c", "_s")


#: Document ids that are ranked together where a weight level of a list is kept in part.
RANK_SPAN = 4096


def levels(postings: DataFrame, term: str = "term") -> DataFrame:
    """(term, _w, _n, _q): how many postings of each list have a weight, all of them kept (_q = _n).

    Lists of common terms are long, weights are few: what a rule keeps of a list is
    decided on these counts, which aggregate before the shuffle.
    """
    return postings.groupBy(term, F.abs("weight").alias("_w")).agg(F.count("*").alias("_n")).withColumn("_q", F.col("_n"))


def _heavier(level: DataFrame, value: Column, term: str) -> Column:
    """Sum of value over the heavier levels of the list."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(term).orderBy(F.col("_w").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def level_mass(level: DataFrame, alpha: float, term: str = "term") -> DataFrame:
    """mass_exclusive() on the levels of integer weights."""
    if not 0 < alpha < 1:
        return level
    mass = F.col("_w") * F.col("_q")
    level = level.withColumn("_b", _heavier(level, mass, term)).withColumn("_s", F.sum(mass).over(Window.partitionBy(term)))
    target = _f(alpha) * _f(F.col("_s"))
    # Running masses are integers: compared as integers, and with the target in single precision.
    whole = F.when(_f(F.col("_b")) <= target, F.col("_q")).otherwise(0)
    some = F.least(F.col("_q"), F.greatest(F.lit(0), F.floor((target.cast("double") - F.col("_b")) / F.col("_w"))))
    return level.withColumn("_q", F.when(F.col("_w") == 0, whole).otherwise(some).cast("long")).drop("_b", "_s").where("_q > 0")


def level_ratio(level: DataFrame, ratio: float, term: str = "term") -> DataFrame:
    """list_ratio() on levels."""
    if not 0 < ratio < 1:
        return level
    top = F.max("_w").over(Window.partitionBy(term))
    return level.withColumn("_m", top).where(F.col("_w") > F.col("_m").cast("double") * _f(ratio).cast("double")).drop("_m")


def level_top(level: DataFrame, n: int, term: str = "term") -> DataFrame:
    """fixed_top() on levels."""
    if n <= 0:
        return level
    before = _heavier(level, F.col("_q"), term)
    return level.withColumn("_q", F.least(F.col("_q"), F.lit(n) - before)).where("_q > 0")


def take_levels(postings: DataFrame, level: DataFrame, term: str = "term", doc: str = "doc_id", small: bool | None = None) -> DataFrame:
    """The postings that levels keep: of a level kept in part those with the smallest documents.

    The levels go to the postings where their number allows (``small``; counted if not
    given).  A level kept in part is counted by spans of RANK_SPAN document ids; only
    the span that holds the cut is ranked, so no task gets a level whole.  The document
    at the cut joins the levels, and postings are joined with these once, where they
    are.  Ids that are no integers are ranked by level.  A list holds a document once.
    """
    kept = level.where("_q > 0").select(term, "_w", "_n", "_q")
    small = is_small(kept, BROADCAST_ROWS) if small is None else small
    sent = F.broadcast if small else lambda df: df
    weighed = postings.withColumn("_w", F.abs("weight"))
    part = weighed.join(sent(kept.where("_q < _n")), [term, "_w"])
    integer = isinstance(postings.schema[doc].dataType, IntegralType)
    part = part.withColumn("_span", F.expr(f"`{doc}` div {RANK_SPAN}") if integer else F.lit(0).cast("long"))
    spans = part.groupBy(term, "_w", "_q", "_span").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(term, "_w").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_left", F.col("_q") - before).where("_left > 0 AND _left <= _c").select(term, "_w", "_span", "_left")
    rank = F.row_number().over(Window.partitionBy(term, "_w").orderBy(doc))
    inside = part.select(term, "_w", "_span", doc).join(sent(spans), [term, "_w", "_span"])
    cut = inside.withColumn("_r", rank).where("_r = _left").select(term, "_w", F.col(doc).alias("_cut"))
    kept = kept.select(term, "_w").join(cut, [term, "_w"], "left")
    held = weighed.join(sent(kept), [term, "_w"])
    return held.where(F.col("_cut").isNull() | (F.col(doc) <= F.col("_cut"))).select(postings.columns)


def list_mass_exclusive(postings: DataFrame, alpha: float, term: str = "term", doc: str = "doc_id") -> DataFrame:
    """mass_exclusive() for posting lists of integer weights, without a task per term."""
    if not 0 < alpha < 1:
        return postings
    return take_levels(postings, level_mass(levels(postings, term), alpha, term), term, doc)


def mass_inclusive(df: DataFrame, by: str, tie: str, alpha: float, guard: bool = True) -> DataFrame:
    """Keep the shortest prefix whose running mass (signed) reaches alpha of the total; one at least."""
    if guard and not 0 < alpha < 1:
        return df
    order = _order(by, tie, signed=True)
    done = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = df.withColumn("_d", done).withColumn("_s", F.sum("weight").over(Window.partitionBy(by))).withColumn("_r", F.row_number().over(order))
    return kept.where((F.col("_r") == 1) | (_f(F.col("_d")) < _f(alpha) * _f(F.col("_s")))).drop("_d", "_s", "_r")


def mass_inclusive_int8(df: DataFrame, by: str, tie: str, alpha: float) -> DataFrame:
    """mass_inclusive() as an 8-bit accumulator computes it: sums wrap, the target is cut to an integer."""
    if not 0 < alpha < 1:
        return df
    order = _order(by, tie, signed=True)
    run = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = df.withColumn("_c", wrap_int8(run)).withColumn("_s", wrap_int8(F.sum("weight").over(Window.partitionBy(by))))
    kept = kept.withColumn("_p", F.max("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return kept.where(F.col("_p").isNull() | (F.col("_p") < (_f(alpha) * _f(F.col("_s"))).cast("int"))).drop("_c", "_s", "_p")


def _with_max(df: DataFrame, by: str, top: Column) -> DataFrame:
    return df.withColumn("_m", F.max(top).over(Window.partitionBy(by)))


def doc_ratio(df: DataFrame, by: str, ratio: float) -> DataFrame:
    """Keep weights strictly above the integer part of ratio times the largest."""
    if not 0 <= ratio < 1:
        return df
    return _with_max(df, by, F.abs("weight")).where(F.abs("weight") > (_f(F.col("_m")) * _f(ratio)).cast("int")).drop("_m")


def list_ratio(postings: DataFrame, ratio: float, term: str = "term") -> DataFrame:
    """Keep weights strictly above ratio times the list's largest, in double precision.

    The maximum is aggregated and joined back: long lists stay where they are.
    """
    if not 0 < ratio < 1:
        return postings
    top = bounded_broadcast(postings.groupBy(term).agg(F.max(F.abs("weight")).alias("_m")), BROADCAST_ROWS)
    return postings.join(top, term).where(F.abs("weight") > F.col("_m").cast("double") * _f(ratio).cast("double")).select(postings.columns)


def query_ratio(df: DataFrame, by: str, ratio: float) -> DataFrame:
    """Keep weights at or above the integer part of ratio times the largest."""
    if not ratio > 0:
        return df
    return _with_max(df, by, F.col("weight")).where(F.col("weight") >= (_f(ratio) * _f(F.col("_m"))).cast("int")).drop("_m")


def plain_ratio(df: DataFrame, by: str, ratio: float | None) -> DataFrame:
    """Keep weights at or above ratio times the largest, in double precision (converter and cluster engine)."""
    if ratio is None:
        return df
    top = bounded_broadcast(df.groupBy(by).agg(F.max("weight").alias("_m")), BROADCAST_ROWS)
    return df.join(top, by).where(F.col("weight").cast("double") >= F.col("_m") * F.lit(float(ratio))).select(df.columns)


def fixed_top(df: DataFrame, by: str, tie: str, n: int, signed: bool = False) -> DataFrame:
    """Keep the n largest weights of each group; n < 1 keeps all."""
    if n <= 0:
        return df
    return df.withColumn("_r", F.row_number().over(_order(by, tie, signed))).where(F.col("_r") <= n).drop("_r")


def longest_lists(lengths: DataFrame, fraction: float, term: str = "term", all_terms: int | None = None) -> DataFrame:
    """Of (term, _len), or of postings, the terms with the longest lists, ``fraction`` of all (rounded down), ties by term.

    ``all_terms`` counts terms whose list is already empty too.  The cut is found on
    the distribution of lengths; terms are ranked only at the length of the cut.
    """
    if "_len" not in lengths.columns:
        lengths = lengths.groupBy(term).agg(F.count("*").alias("_len"))
    spread = lengths.groupBy("_len").agg(F.count("*").alias("_n"))  # few rows: one per length
    total = F.lit(all_terms) if all_terms is not None else F.sum("_n").over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("_len").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.floor(_f(total) * _f(fraction)).cast("long")
    spread = spread.withColumn("_q", F.least(F.col("_n"), quota - before)).where("_q > 0").select("_len", "_n", "_q")
    alone = F.when(F.col("_q") >= F.col("_n"), F.col(term))
    rank = F.row_number().over(Window.partitionBy("_len", alone).orderBy(term))
    return lengths.join(spread, "_len").withColumn("_r", rank).where("_r <= _q").select(term)


def drop_longest_lists(postings: DataFrame, fraction: float, term: str = "term", all_terms: int | None = None) -> DataFrame:
    """Postings without the longest lists."""
    if not 0 < fraction < 1:
        return postings
    lengths = postings.groupBy(term).agg(F.count("*").alias("_len"))
    return postings.join(bounded_broadcast(longest_lists(lengths, fraction, term, all_terms), BROADCAST_ROWS), term, "left_anti")


def audit(original: DataFrame, pruned: DataFrame, postings: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """Per term that some vector lost: how many lost it, and the length of its list."""
    lost = original.join(pruned.select(doc, term), [doc, term], "left_anti").groupBy(term).agg(F.count("*").alias("pruned_count"))
    return lost.join(postings.groupBy(term).agg(F.count("*").alias("posting_list_length")), term, "left").select(term, "pruned_count", F.coalesce("posting_list_length", F.lit(0)).cast("long").alias("posting_list_length"))


@dataclass(frozen=True)
class VectorPrune:
    """Knobs for documents or posting lists; the defaults prune nothing."""

    alpha: float = 0.0
    max_ratio: float = -1.0
    fixed_top: int = -1
    longest: float = 0.0


def prune_docs(docs: DataFrame, p: VectorPrune, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """Mass, then ratio, then count."""
    return fixed_top(doc_ratio(mass_exclusive(docs, doc, term, p.alpha), doc, p.max_ratio), doc, term, p.fixed_top)


def prune_lists(postings: DataFrame, p: VectorPrune, doc: str = "doc_id", term: str = "term", integers: bool = True) -> DataFrame:
    """Mass, then ratio, then count, then the longest lists.

    With ``integers`` as weights all rules are decided on one table of levels, and
    postings are joined with it once.
    """
    if p == VectorPrune():
        return postings
    if not integers:
        out = list_ratio(mass_exclusive(postings, term, doc, p.alpha), p.max_ratio, term)
        return drop_longest_lists(fixed_top(out, term, doc, p.fixed_top), p.longest, term)
    kept = level_top(level_ratio(level_mass(levels(postings, term), p.alpha, term), p.max_ratio, term), p.fixed_top, term)
    if not 0 < p.longest < 1:
        return take_levels(postings, kept, term, doc)
    left, few = _without_longest(kept, p.longest, term)
    return take_levels(postings, left, term, doc, few)


def _without_longest(level: DataFrame, fraction: float, term: str) -> tuple[DataFrame, bool]:
    """drop_longest_lists() on levels, and whether few enough are left to broadcast.

    One job counts lists and levels by length; the driver finds the length of the cut,
    and only lists of that length are ranked.
    """
    by_length = level.groupBy(term).agg(F.sum("_q").alias("_len"), F.count("*").alias("_l")).groupBy("_len")
    spread = by_length.agg(F.count("*").alias("n"), F.sum("_l").alias("l")).orderBy(F.col("_len").desc()).collect()  # a row per length
    lists = sum(r["n"] for r in spread)
    quota = int(np.floor(np.float32(lists) * np.float32(fraction)))
    few = sum(r["l"] for r in spread) <= BROADCAST_ROWS
    at = None
    for r in spread:
        at = r["_len"]
        if quota < r["n"]:
            break
        quota -= r["n"]
    if at is None:
        return level, True
    level = level.withColumn("_len", F.sum("_q").over(Window.partitionBy(term))).where(F.col("_len") <= at)
    if quota:  # of the lists of that length the first by term go
        tied = F.when(F.col("_len") != at, F.col(term))
        level = level.withColumn("_t", F.dense_rank().over(Window.partitionBy("_len", tied).orderBy(term))).where((F.col("_len") < at) | (F.col("_t") > quota))
    return level, few


@dataclass(frozen=True)
class QueryPrune:
    """Knobs for queries.

    ``compose="first"`` applies the first active rule of mass, ratio, count (inclusive
    rules); ``"all"`` applies each in turn (exclusive rules).  ``scope="indexed"``
    drops terms without a list before pruning, ``"all"`` after.
    """

    alpha: float = 0.0
    max_ratio: float = -1.0
    fixed_top: int = -1
    compose: str = "first"
    scope: str = "indexed"
    int8_wrap: bool = False


def prune_queries(queries: DataFrame, p: QueryPrune, terms: DataFrame | None = None, query: str = "query_id", term: str = "term") -> DataFrame:
    known = (lambda q: q.join(terms.select(term).distinct(), term, "left_semi")) if terms is not None else (lambda q: q)
    if p.scope == "indexed":
        queries = known(queries)
    if p.compose == "all":
        out = fixed_top(doc_ratio(mass_exclusive(queries, query, term, p.alpha), query, p.max_ratio), query, term, p.fixed_top)
    elif 0 < p.alpha < 1:
        out = (mass_inclusive_int8 if p.int8_wrap else mass_inclusive)(queries, query, term, p.alpha)
    elif p.max_ratio > 0:
        out = query_ratio(queries, query, p.max_ratio)
    else:
        out = fixed_top(queries, query, term, p.fixed_top, signed=True)
    return out if p.scope == "indexed" else known(out)
