"""Column functions for scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Softmax of an array of doubles, shifted by the maximum."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def add_up(columns: list[Column], start: float = 0.0) -> Column:
    """Left-to-right sum of columns, inside generated code."""
    return reduce(lambda acc, c: acc + c, columns, F.lit(start))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where it is not defined."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", value)
