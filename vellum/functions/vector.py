"""Vector arithmetic as Column expressions over array<double>; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vector(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def prefixed(df: DataFrame, prefix: str = "dim_") -> list[str]:
    """Columns whose name starts with `prefix`, in table order."""
    return [c for c in df.columns if c.startswith(prefix)]


def complete(v: Column) -> Column:
    """Neither null nor with a null or NaN component."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v / |v|; a zero vector is returned unchanged."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def negative_inner(a: Column, b: Column) -> Column:
    return -dot(a, b)


def inverse_l2(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + l2(a, b))


def inverse_squared_l2(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    return 1 / (1 + squared_l2(a, b))


#: name -> (expression, whether larger is nearer)
METRICS = {
    "cosine": (cosine, True),
    "dot": (dot, True),
    "inverse_l2": (inverse_l2, True),
    "inverse_squared_l2": (inverse_squared_l2, True),
    "cosine_distance": (cosine_distance, False),
    "l2": (l2, False),
    "negative_inner": (negative_inner, False),
}
