"""Small helpers for expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rotate(items: Column) -> Column:
    """The array shifted left by one: pairs with the original to walk a closed ring."""
    return F.when(F.size(items) > 0, F.concat(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1))).otherwise(items)


def present(*values: Column, drop: tuple[str, ...] = ("",)) -> Column:
    """The non-null values that are not in ``drop``, in order, as one array."""
    return F.filter(F.array(*values), lambda v: v.isNotNull() & ~v.isin(*drop))
