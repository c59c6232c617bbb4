"""Running aggregates that stay distributed when one key holds most of the rows.

A plain window over a hot key sends all its rows to one task. Here the rows of a key are cut into
blocks of consecutive order numbers, each block is one bounded window partition, and what earlier
blocks contribute arrives through a small carry table with one row per key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SIZE = 1 << 16
BLOCK = "_block"

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def with_blocks(df: DataFrame, order: str, size: int = BLOCK_SIZE) -> DataFrame:
    """Add the block number; ``order`` is a whole number, unique within a key."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / size))


def block_window(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


def earlier_blocks(keys: list[str]) -> Window:
    """Window over block totals: everything of the key before this block."""
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _combine(op: str, carried: Column, local: Column) -> Column:
    if op == "sum":
        zero = F.lit(0)
        return F.coalesce(carried, zero) + F.coalesce(local, zero)
    return F.greatest(carried, local) if op == "max" else F.least(carried, local)


def running_before(df: DataFrame, keys: list[str], order: str,
                   aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add aggregates over all earlier rows of the key (the row itself left out).

    ``aggregates`` maps the new column to ``("sum" | "max" | "min", value)``. ``df`` needs the
    column from :func:`with_blocks`. Sums start at 0; maxima and minima at null.
    """
    block_keys = [*keys, BLOCK]
    totals = df.groupBy(*block_keys).agg(
        *[_AGGREGATES[op](value).alias(f"_total_{name}") for name, (op, value) in aggregates.items()])
    carry = totals.select(*block_keys, *[
        _AGGREGATES[op](f"_total_{name}").over(earlier_blocks(keys)).alias(f"_carry_{name}")
        for name, (op, _) in aggregates.items()])
    local = block_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(carry, block_keys)
    added = {name: _combine(op, F.col(f"_carry_{name}"), _AGGREGATES[op](value).over(local))
             for name, (op, value) in aggregates.items()}
    return joined.withColumns(added).drop(*[f"_carry_{name}" for name in aggregates])
