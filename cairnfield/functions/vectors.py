"""Vector expressions over ``array<float>`` columns; scores are computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, which is their dot product; null when the lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row; a repeated sub-expression would run per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Divide by the norm; vectors of (almost) zero length are left as they are."""

    def scaled(vec: Column) -> Column:
        divisor = F.when(norm(vec) > NORM_FLOOR, norm(vec)).otherwise(1.0)
        return _let(divisor, lambda d: F.transform(vec, lambda x: x.cast("double") / d))

    return _let(v, scaled)


def _scaler(weight: float):
    return lambda x: x * F.lit(weight)


def weighted_blocks(v: Column, sizes: Sequence[int], weights: Sequence[float]) -> Column:
    """Normalise consecutive blocks of ``v``, scale each by its weight, join them and normalise the whole."""
    parts, start = [], 1
    for size, weight in zip(sizes, weights, strict=True):
        block = l2_normalize(F.slice(v, start, size))
        parts.append(F.transform(block, _scaler(float(weight))))
        start += size
    return l2_normalize(F.concat(*parts))


def is_valid(v: Column, dim: int) -> Column:
    """Right length, no nulls and no NaN."""
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return v.isNotNull() & (F.size(v) == dim) & ~F.coalesce(broken, F.lit(False))
