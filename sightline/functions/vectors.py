"""Embedding arithmetic on ``array<float>`` columns, accumulated in double.

These are for row-local work (validation, one similarity per row).  Scoring sets of
vectors against each other belongs in ``operators.similarity``, which multiplies blocks.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F

# Smallest norm that can still be divided by: the float32 machine epsilon.
FLOAT32_EPS = 1.1920928955078125e-07


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null when the lengths differ: such a pair is invalid, not zero."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    squares = F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def is_usable(v: Column) -> Column:
    """Non-empty, all finite, and long enough to be normalised."""
    finite = F.forall(as_double(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        (F.size(v) > 0) & finite & (norm(v) > FLOAT32_EPS), F.lit(False)
    )


def normalized(v: Column) -> Column:
    """Unit vector, or null where the input cannot be normalised."""
    length = norm(v)
    return F.when(is_usable(v), F.transform(as_double(v), lambda x: x / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two usable vectors of equal length, otherwise null."""
    return F.when(is_usable(a) & is_usable(b), dot(a, b) / (norm(a) * norm(b)))


def mean_vector(v: Column) -> Column:
    """Element-wise mean as an aggregate with map-side partial sums of whole vectors."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))
