"""Column expressions on ARRAY<FLOAT|DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column, eps: float = 1e-12) -> Column:
    """Unit vector; the norm is bound once through a one-element array."""
    scale = F.array(norm(v) + eps)
    return F.flatten(F.transform(scale, lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def one_hot(index: Column, size: Column) -> Column:
    """``index`` is zero-based."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def hot_position(v: Column) -> Column:
    """Zero-based position of the 1; 0 when there is none."""
    return F.greatest(F.array_position(v, F.lit(1.0)) - 1, F.lit(0))


def hashed_buckets(tokens: Column, buckets: int = 16) -> Column:
    """Signed token counts in ``buckets`` cells; cell and sign come from the MD5 of the token."""
    codes = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))
    cells = F.sequence(F.lit(0), F.lit(buckets - 1))

    def cell(cs: Column, b: Column) -> Column:
        return F.aggregate(cs, F.lit(0.0), lambda s, c: s + F.when(
            c % buckets != b, 0.0).when(F.floor(c / buckets) % 2 == 0, 1.0).otherwise(-1.0))

    # a one-element array binds the codes, so that each token is hashed once
    return F.flatten(F.transform(F.array(codes), lambda cs: F.transform(cells, lambda b: cell(cs, b))))
