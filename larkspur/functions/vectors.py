"""Vector scalars over ARRAY<FLOAT> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


def mean_pool(rows: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0 (ARRAY<ARRAY<FLOAT>>, ARRAY<INT>)."""
    used = F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    total = F.aggregate(F.slice(used, 2, F.greatest(F.size(used) - 1, F.lit(0))), F.transform(F.element_at(used, 1), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(used), F.lit(1)))


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic pseudo-random unit vector from a hash of the text: for tests and offline runs."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), i), F.lit(2000003)).cast("double") / 1000001.0) - 1.0)
    return l2_normalize(raw)
