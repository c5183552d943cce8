"""Vector arithmetic on array columns."""

from pyspark.sql import Column, functions as F

from .ordering import _col


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine similarity; null when a vector has no length."""
    a, b = _col(a), _col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))
