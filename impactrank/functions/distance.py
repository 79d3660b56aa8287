"""Similarities of sparse vectors in long form, and of dense arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: DataFrame, b: DataFrame, a_id: str, b_id: str, term: str = "term") -> DataFrame:
    """Inner products of all pairs with a term in common."""
    x, y = a.select(a_id, term, F.col("weight").alias("wa")), b.select(b_id, term, F.col("weight").alias("wb"))
    return x.join(y, term).groupBy(a_id, b_id).agg(F.sum(F.col("wa").cast("long") * F.col("wb")).alias("dot"))


def norms(a: DataFrame, a_id: str) -> DataFrame:
    """Euclidean length of each vector."""
    return a.groupBy(a_id).agg(F.sqrt(F.sum((F.col("weight").cast("long") * F.col("weight"))).cast("double")).alias("norm"))


def cosine(a: DataFrame, b: DataFrame, a_id: str, b_id: str, term: str = "term") -> DataFrame:
    """Cosine of all pairs with a term in common; 0 where a length is 0."""
    pair = dot(a, b, a_id, b_id, term).join(norms(a, a_id).withColumnRenamed("norm", "na"), a_id).join(norms(b, b_id).withColumnRenamed("norm", "nb"), b_id)
    return pair.select(a_id, b_id, F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def _over_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame, a_id: str, b_id: str, term: str, own, common) -> DataFrame:
    """Sum of ``own`` over both vectors plus the sum of ``common`` over terms they share, as ``d``.

    Only shared terms are joined; what a vector contributes alone is summed once per vector.
    """
    w = lambda c: F.col(c).cast("long")
    x, y = a.select(a_id, term, w("weight").alias("wa")), b.select(b_id, term, w("weight").alias("wb"))
    shared = x.join(y, term).groupBy(a_id, b_id).agg(F.sum(common(F.col("wa"), F.col("wb"))).alias("dc"))
    alone = lambda v, i, name: v.groupBy(i).agg(F.sum(own(w("weight"))).alias(name))
    out = pairs.select(a_id, b_id).distinct().join(shared, [a_id, b_id], "left").join(alone(a, a_id, "da"), a_id, "left").join(alone(b, b_id, "db"), b_id, "left")
    zero = F.lit(0).cast("long")
    return out.select(a_id, b_id, (F.coalesce("da", zero) + F.coalesce("db", zero) + F.coalesce("dc", zero)).alias("d"))


def euclidean(a: DataFrame, b: DataFrame, pairs: DataFrame, a_id: str, b_id: str, term: str = "term") -> DataFrame:
    """Euclidean distance of the given pairs; exact for integer weights."""
    d = _over_pairs(a, b, pairs, a_id, b_id, term, lambda w: w * w, lambda x, y: -2 * x * y)
    return d.select(a_id, b_id, F.sqrt(F.col("d").cast("double")).alias("euclidean"))


def manhattan(a: DataFrame, b: DataFrame, pairs: DataFrame, a_id: str, b_id: str, term: str = "term") -> DataFrame:
    """Sum of absolute differences of the given pairs."""
    d = _over_pairs(a, b, pairs, a_id, b_id, term, F.abs, lambda x, y: F.abs(x - y) - F.abs(x) - F.abs(y))
    return d.select(a_id, b_id, F.col("d").alias("manhattan"))


def dot_distance(dot_value: Column) -> Column:
    """Reciprocal of the inner product, kept finite at 0."""
    return F.lit(1.0) / (dot_value.cast("double") + F.lit(1e-9))


def dense_dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sparse_dense_dot(terms: Column, weights: Column, dense: Column) -> Column:
    """Inner product of a sparse vector, as arrays of terms and weights, and a dense array; terms beyond it count 0."""
    parts = F.zip_with(terms, weights, lambda i, w: w.cast("double") * F.coalesce(F.get(dense, i).cast("double"), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def sparse_float_dot_int32(terms: Column, weights: Column, dense: Column) -> Column:
    """sparse_dense_dot() as a 32-bit integer accumulator computes it: the sum is cut to an integer at every term, in the order given."""
    parts = F.zip_with(terms, weights, lambda i, w: w.cast("double") * F.coalesce(F.get(dense, i).cast("double"), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0), lambda s, x: (s.cast("double") + x).cast("int"))


DISTANCES = {"dot": dot, "cosine": cosine, "l2": euclidean, "l1": manhattan}
