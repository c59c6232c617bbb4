"""Grid cells of segments, the equi-join key of every spatial join here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative slack that keeps a segment in a cell it only grazes, whatever the rounding.
SLACK = 1e-9


def _range(first: Column, last: Column, bounds: tuple[Column, Column] | None) -> Column:
    """Whole numbers from first to last, within the bounds if there are any."""
    if bounds is None:
        return F.sequence(first, last)
    low, high = F.greatest(first, bounds[0]), F.least(last, bounds[1])
    return F.when(low <= high, F.sequence(low, high))


def place(sides: DataFrame, width: Column, height: Column, origin_x: Column, origin_y: Column, pad: Column, *,
          names: tuple[str, str] = ("cx", "cy"), limit: Column | None = None, within: tuple[str, str] | None = None, fan: int = 2) -> DataFrame:
    """One row per grid cell that a side (``ax, ay, bx, by``), thickened by ``pad``, passes through.

    The side is followed column by column, so a long diagonal takes a line of cells and not the
    rectangle around it. Plain explodes of number ranges keep all of it in generated code. Cells are
    those below ``limit``, or those that the ``fan`` times as wide cell in the columns ``within`` is cut into.
    """
    bounds = [None, None]
    if limit is not None:
        bounds = [(F.lit(0), (limit - 1).cast("bigint"))] * 2
    elif within is not None:
        bounds = [(F.col(c) * fan, F.col(c) * fan + (fan - 1)) for c in within]
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    low, high = F.least(ax, bx), F.greatest(ax, bx)
    thick_x, thick_y = pad + width * SLACK, pad + height * SLACK
    columns = sides.withColumn(names[0], F.explode(_range(
        F.floor((low - thick_x - origin_x) / width), F.floor((high + thick_x - origin_x) / width), bounds[0])))
    left = origin_x + F.col(names[0]) * width
    slope = (by - ay) / F.when(ax == bx, 1.0).otherwise(bx - ax)
    start = F.least(F.greatest(low, left - thick_x), high)
    end = F.greatest(F.least(high, left + width + thick_x), low)
    clipped = columns.withColumns({
        "_y0": F.when(ax == bx, ay).otherwise(ay + slope * (start - ax)),
        "_y1": F.when(ax == bx, by).otherwise(ay + slope * (end - ax))})
    first = F.floor((F.least("_y0", "_y1") - thick_y - origin_y) / height)
    last = F.floor((F.greatest("_y0", "_y1") + thick_y - origin_y) / height)
    return clipped.withColumn(names[1], F.explode(_range(first, last, bounds[1]))).drop("_y0", "_y1")


def range_cells(low: Column, high: Column, size: float) -> Column:
    """Cells of an interval on a line."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def owns_pair(cell: Column, low_a: Column, low_b: Column, size: float) -> Column:
    """True in exactly one of the cells two overlapping intervals share, so a pair comes up once."""
    return cell == F.floor(F.greatest(low_a, low_b) / size)
