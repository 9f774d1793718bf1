"""Column expressions over ``ARRAY<DOUBLE>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_doubles(vector: Column | str) -> Column:
    return _col(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors of one row; 0 where either has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def unit(vector: Column | str) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    vector = as_doubles(vector)
    # zip_with keeps the norm out of the lambda, where it would run per element.
    lengths = F.array_repeat(norm(vector), F.size(vector))
    return F.zip_with(vector, lengths, lambda x, n: F.when(n == 0.0, x).otherwise(x / n))


def is_valid(vector: Column | str, dim: int | None = None) -> Column:
    """Not NULL, of the wanted size, and made of finite numbers only."""
    vector = as_doubles(vector)
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    sized = F.size(vector) == dim if dim is not None else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & sized & finite, F.lit(False))


def mean_vector(vector: Column | str) -> Column:
    """Aggregate: element-wise mean, with partial sums before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(as_doubles(vector))))


def density_score(lof: Column | str) -> Column:
    """Outlier factor to a score between 0 and 1: logistic of ``1.5 - lof``, clipped to ±60."""
    decision = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(1.5) - _col(lof)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-decision))
