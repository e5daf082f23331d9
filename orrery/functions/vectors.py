"""Functions of dense vectors of any dimension, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def doubles(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def constant(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, na=None, nb=None) -> Column:
    """Zero where either vector has no length; vectors of two lengths are an error."""
    n = (na if na is not None else norm(a)) * (nb if nb is not None else norm(b))
    same = F.when(F.size(_c(a)) == F.size(_c(b)), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of different dimension")).cast("boolean"))
    return F.when(same & (n < 2.220446049250313e-16), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(a) -> Column:
    """Unit length; the zero vector becomes the first axis."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x, i: F.when(i == 0, 1.0).otherwise(0.0)))


def gaussian(a, b, sigma: float) -> Column:
    d = euclidean(a, b)
    return F.exp(-(d * d) * (0.5 / sigma**2))


def active_axes(a, threshold: float) -> Column:
    return F.filter(F.transform(_c(a), lambda x, i: F.when(F.abs(x) > threshold, i)), lambda i: i.isNotNull())


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def is_finite(a) -> Column:
    return F.forall(_c(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
