"""Null- and ANSI-safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num0(x: Column | str) -> Column:
    """A number from text; blank, NA and other text count as 0."""
    return F.coalesce(_col(x).try_cast("double"), F.lit(0.0))


def int_or_null(x: Column | str) -> Column:
    """A whole number from text such as "3" or "3.0", else null."""
    return _col(x).try_cast("double").try_cast("int")


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(x)))


def rounded(x: Column | str, digits: int) -> Column:
    """A sum of doubles, rounded: first to five digits more, so that the order in which it was summed,
    which shows in the last bits only, can't decide a half."""
    return F.round(F.round(_col(x), digits + 5), digits)


def ratio0(a: Column | str, b: Column | str) -> Column:
    """a / b, or 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(_col(a), _col(b)), F.lit(0.0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """An aggregate: sum(w x) / sum(w); a zero total counts as 1."""
    total = F.sum(_col(weight))
    return F.sum(_col(value) * _col(weight)) / F.when(total == 0, F.lit(1.0)).otherwise(total)


def ladder(x: Column | str, steps, otherwise) -> Column:
    """The label of the first step (end, label) with x <= end."""
    out = None
    for end, label in steps:
        out = F.when(_col(x) <= end, F.lit(label)) if out is None else out.when(_col(x) <= end, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def squared_distance(pairs, weights) -> Column:
    """sum of w (a - b)^2, unrolled so that it stays in generated code."""
    out = F.lit(0.0)
    for (a, b), w in zip(pairs, weights, strict=True):
        d = _col(a) - _col(b)
        out = out + F.lit(w) * d * d
    return out


def inverse_distance(squared: Column, scale: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(squared) / F.lit(scale))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of two arrays; 0 if their lengths differ or one has no norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(_col(x), _col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(_col(a)) != F.size(_col(b)), F.lit(0.0)).otherwise(ratio0(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))
