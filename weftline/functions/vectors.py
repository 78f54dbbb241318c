"""Vector arithmetic on arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def checked_width(a: Column, width: int, subject: Column) -> Column:
    """The vector, or an error that names its subject where the width is another."""
    return F.when(a.isNull() | (F.size(a) == width), a).otherwise(F.raise_error(F.concat(F.lit("vector of a wrong width: "), subject)))
