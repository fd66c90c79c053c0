"""Array helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def median(values: Column) -> Column:
    """The interpolated median of an array of doubles; null if it is empty."""
    n = F.size(values)
    middle = lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, let(F.sort_array(values), middle))
