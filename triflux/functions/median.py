"""The median of a short array of integers, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _middle(values: Column) -> tuple[Column, Column]:
    ordered = F.array_sort(values)
    n = F.size(values)
    # For an odd length both positions are the middle one.
    low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    return low, high


def integer_median(values: Column) -> Column:
    """Median of an ARRAY<BIGINT>; the mean of two middle values truncates toward zero."""
    low, high = _middle(values)
    return F.when(low == high, low).otherwise(F.call_function("div", low + high, F.lit(2)))


def decimal_median(values: Column) -> Column:
    """The same for an array of non-negative DECIMAL(38,0) values."""
    low, high = _middle(values)
    half = F.floor((low + high) / F.lit(2)).cast("decimal(38,0)")
    return F.when(low == high, low).otherwise(half)
