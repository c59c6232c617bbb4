"""Rounding that agrees with the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Splits a double into two 26-bit halves so that products have no rounding error.
SPLIT = 134217729.0
# From here up, doubles have no digits beyond the second decimal that could be rounded.
WHOLE_HUNDREDTHS = 2.0 ** 53 / 100


def fixed2(value: Column) -> Column:
    """Round to two decimals by the exact value of the double, ties away from zero.

    ``F.round`` goes through the shortest decimal text, so 1.005 would become 1.01 although the
    stored double is below 1.005. Here ``100 * x`` is carried with its exact error term. Values that are
    not finite, or too large to have a third decimal, stay as they are.
    """
    size = F.abs(value)
    high = size * SPLIT - (size * SPLIT - size)
    error = (high * 100.0 - size * 100.0) + (size - high) * 100.0
    base = F.floor(size * 100.0).cast("double")
    step = F.when((size * 100.0 - base - 0.5) + error >= 0, 1.0).otherwise(0.0)
    rounded = F.when(value < 0, -(base + step) / 100.0).otherwise((base + step) / 100.0)
    return F.when(size < WHOLE_HUNDREDTHS, rounded).otherwise(value)


def fixed2_sql(value: str) -> str:
    """The same rule as SQL text, for checking results in another engine."""
    size = f"abs({value})"
    high = f"({size} * {SPLIT}::DOUBLE - ({size} * {SPLIT}::DOUBLE - {size}))"
    error = f"(({high} * 100.0::DOUBLE - {size} * 100.0::DOUBLE) + ({size} - {high}) * 100.0::DOUBLE)"
    base = f"floor({size} * 100.0::DOUBLE)"
    step = f"(CASE WHEN ({size} * 100.0::DOUBLE - {base} - 0.5::DOUBLE) + {error} >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return (f"(CASE WHEN {size} < {WHOLE_HUNDREDTHS!r}::DOUBLE THEN "
            f"CASE WHEN {value} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * ({base} + {step}) / 100.0::DOUBLE ELSE {value} END)")


def number_text(value: Column) -> Column:
    """Shortest decimal text without exponent or trailing ``.0`` (``3``, ``0.25``, ``0.0001``); no digit is lost.

    The digits are those of the engine's shortest text, with the point moved by its exponent. A value that is
    missing or not finite has no such text and is an error, so that a list of numbers never loses one.
    """
    def written(text: Column) -> Column:
        mantissa, exponent = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        point = F.instr(mantissa, ".") - 1 + exponent
        moved = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
                 .otherwise(F.concat(F.substr(F.rpad(digits, F.greatest(point, F.length(digits)), F.lit("0")), F.lit(1), point), F.lit("."),
                                     F.substr(digits, point + 1))))
        # Most numbers have no exponent, and then an idle zero only stands alone behind the point.
        return (F.when(F.endswith(text, F.lit(".0")), F.substr(text, F.lit(1), F.length(text) - 2)).when(~F.contains(text, F.lit("E")), text)
                .otherwise(F.regexp_replace(F.regexp_replace(moved, r"(\.\d*?)0+$", "$1"), r"\.$", "")))

    number = value.cast("double")
    signed = F.concat(F.when(number < 0, "-").otherwise(""), let(F.abs(number).cast("string"), written))
    finite = F.coalesce(F.abs(number) < float("inf"), F.lit(False))
    return F.when(finite, signed).otherwise(F.raise_error(F.concat(F.lit("not a finite number: "), F.coalesce(value.cast("string"), F.lit("null")))))
