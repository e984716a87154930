"""Vectors as arrays: products in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = 1e-8) -> Column:
    """``v`` over its length; the length is computed once."""
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def median_signs(v: Column) -> Column:
    """1 where a coefficient is above the median of all but the first, else -1; the first is left out."""
    rest = F.slice(v, 2, F.size(v))
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.element_at(F.transform(F.array(middle(F.array_sort(rest))), lambda m: F.transform(rest, lambda x: F.when(x > m, 1).otherwise(-1))), 1)


def weighted_concat(parts: list[tuple[Column, float]]) -> Column:
    """Unit vectors scaled by the roots of their normalised weights, joined, and normalised."""
    total = sum(w for _, w in parts)
    times = lambda s: lambda x: x * F.lit(s)
    scaled = [F.transform(l2_normalize(v), times((w / total) ** 0.5)) for v, w in parts]
    return l2_normalize(F.concat(*scaled))
