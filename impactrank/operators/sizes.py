"""Broadcasts behind a count of what is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most so many short rows goes to every executor; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that df is small enough."""
    return F.broadcast(df) if is_small(df, rows) else df
