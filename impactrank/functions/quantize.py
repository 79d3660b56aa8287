"""Scalar quantizers; single precision inside, so results do not depend on the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(raw: Column, largest: float = 3.0, levels: int = 127) -> Column:
    """Clamp to [0, largest] and map to 0..levels, halves away from zero.

    Spark divides floats in double precision, so the quotient is rounded to a float before it is multiplied.
    """
    top = F.lit(largest).cast("float")
    clamped = F.least(F.greatest(raw.cast("float"), F.lit(0.0).cast("float")), top)
    return F.floor(((clamped / top).cast("float") * F.lit(float(levels)).cast("float")).cast("double") + F.lit(0.5)).cast("int")


def signed(raw: Column, largest: float = 3.0) -> Column:
    """Clamp to [-largest, largest] and map to -127..127, halves away from zero."""
    return F.when(raw < 0, -positive(-raw, largest)).otherwise(positive(raw, largest))


def unsigned_byte(raw: Column, largest: float = 3.0) -> Column:
    """Clamp to [0, largest] and map to 0..255, halves to even."""
    top = F.lit(largest)
    return F.rint(F.least(F.greatest(raw.cast("double"), F.lit(0.0)), top) / top * F.lit(255.0)).cast("int")


def dense_to_sparse(df: DataFrame, id_col: str, array_col: str, eps: float = 1e-6) -> DataFrame:
    """(id, term, value) for each position whose value is not about 0."""
    return df.select(id_col, F.posexplode(array_col).alias("term", "value")).where(F.abs("value") > F.lit(eps))


def sparse_to_dense(vectors: DataFrame, id_col: str, size: int, term_col: str = "term") -> DataFrame:
    """One fixed-size array per id; terms at or beyond ``size`` are left out."""
    held = vectors.where((F.col(term_col) >= 0) & (F.col(term_col) < size)).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(term_col, "weight"))).alias("m"))
    return held.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("dense"))


def wrap_int8(x: Column) -> Column:
    """The value an 8-bit two's-complement accumulator would hold."""
    return F.pmod(x + F.lit(128), F.lit(256)) - F.lit(128)
