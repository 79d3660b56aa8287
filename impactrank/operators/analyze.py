"""Statistics of the index and of latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locality(postings: DataFrame) -> DataFrame:
    """How close together a term's documents lie inside windows (postings with window_id, local_idx)."""
    size = F.count("*").over(Window.partitionBy("term", "window_id"))
    gap = F.col("local_idx") - F.lag("local_idx").over(Window.partitionBy("term", "window_id").orderBy("local_idx"))
    rows = postings.select("term", "window_id", "local_idx").withColumn("n", size).withColumn("gap", gap)
    return rows.agg(
        F.count("*").alias("entries"),
        F.sum(F.when((F.col("n") >= 2) & F.col("gap").isNull(), 1).otherwise(0)).cast("long").alias("windows_with_data"),
        F.round(F.avg("gap"), 6).alias("avg_gap"),
        F.round(F.avg(F.when(F.col("gap").isNotNull(), F.when(F.col("gap") == 1, 1.0).otherwise(0.0))), 6).alias("consecutive_ratio"),
    )


#: Parts that order statistics are looked for in, about equal in rows.
RANK_PARTS = 256


def latency_stats(df: DataFrame, value: str, fractions: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """Mean, extremes, and order statistics at index floor(n * p), at most n - 1; no interpolation.

    Distinct values are counted and cut into parts at approximate quantiles; totals of
    the parts tell where ranks fall, and running counts are taken inside parts only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    at = [i / RANK_PARTS for i in range(1, RANK_PARTS)]
    cuts = sorted(set(counts.agg(F.percentile_approx("v", at, 10_000)).first()[0] or []))
    part = F.lit(0)
    if cuts:
        # The number of cuts at or below a value, by halving.
        def below(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.col("v") < F.lit(cuts[mid]), below(low, mid)).otherwise(below(mid + 1, high))

        part = below(0, len(cuts))
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("part").agg(F.sum("c").alias("t"))  # RANK_PARTS rows at most
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("t").over(everything.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("part", before.alias("before"), F.sum("t").over(everything).alias("n"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    run = counts.join(F.broadcast(totals), "part").select("v", "c", "n", upto.alias("upto"))
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col("v")))
    return run.agg(
        F.max("n").cast("long").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"),
        pick(0.5).alias("median"), *[pick(p).alias(f"p{round(p * 100)}") for p in fractions],
    )


def stage_breakdown(timings: DataFrame) -> DataFrame:
    """(group, tag, seconds) summed, with each tag's share of its group in per cent."""
    per = timings.groupBy("group", "tag").agg(F.sum("seconds").alias("seconds"))
    return per.withColumn("percent", F.round(F.col("seconds") * 100 / F.sum("seconds").over(Window.partitionBy("group")), 2))


def throughput(n_queries: int, seconds: float) -> float:
    """Queries a second of a batch."""
    return n_queries / seconds if seconds > 0 else float("inf")
