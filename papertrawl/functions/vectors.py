"""Vector column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrawl.functions.text import ColumnOrName, col


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Null when either vector is all zeros."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)
