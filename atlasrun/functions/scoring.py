"""Exact scores and report texts as integer and decimal column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .numbers import fixed2

# Three attempts per target and the credit of each; the score loses 25/9 per second.
ATTEMPTS = 3
CREDITS = (1.0, 0.5, 0.25)
PENALTY_NUMERATOR = 25
PENALTY_DENOMINATOR = 9
FULL_SCORE = 10000
# Report tiers, lowest score of each.
TIERS = (
    (7500, "Celebration", "Outstanding run"),
    (5000, "Great work", "A strong run"),
    (2500, "Keep going", "You are building momentum"),
)
LOWEST_TIER = ("Keep practicing", "Every run is progress")


# Decimal places kept of a fractional accuracy.
ACCURACY_PLACES = 17


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Whole-number quotient rounded half up, zero when the numerator is not positive."""
    quotient = F.call_function("div", numerator * 2 + denominator, denominator * 2)
    return F.when(numerator <= 0, F.lit(0)).otherwise(quotient).cast("bigint")


def _checked(problem: Column, message: str, value: Column) -> Column:
    return F.when(problem, F.raise_error(F.lit(message)).cast("bigint")).otherwise(value)


def final_score(accuracy_hundredths: Column, seconds: Column) -> Column:
    """``max(0, round_half_up(accuracy - 25/9 * seconds))`` from accuracy hundredths, exactly.

    The accuracy is scaled to a whole number, so fractional accuracies round correctly too.
    """
    # Hundredths as a whole number of the last place: a cast that moves the point, not a product of wide decimals.
    unit = 10 ** ACCURACY_PLACES
    scaled = F.struct(F.floor(accuracy_hundredths.cast(f"decimal(30,{ACCURACY_PLACES})")).cast("decimal(13,0)").alias("whole"),
                      accuracy_hundredths.cast(f"decimal(30,{ACCURACY_PLACES})").alias("all"))
    rest = F.lit(unit).cast("decimal(18,0)")

    def rounded(x: Column) -> Column:
        units = (x["all"] * rest).cast("decimal(30,0)")
        loss = seconds.cast("decimal(10,0)") * F.lit(unit * PENALTY_NUMERATOR).cast("decimal(20,0)")
        return let((units * PENALTY_DENOMINATOR - loss).cast("decimal(36,0)"), lambda n: _half_up(n, F.lit(unit * PENALTY_DENOMINATOR).cast("decimal(19,0)")))

    def exact(x: Column) -> Column:
        """Whole accuracies, the most, take whole-number arithmetic."""
        points = x["whole"].cast("bigint") * PENALTY_DENOMINATOR - seconds.cast("bigint") * PENALTY_NUMERATOR
        small = (x["all"] == x["whole"]) & (x["whole"] < 10 ** 12) & (seconds < 10 ** 12)
        return F.when(small, _half_up(points, F.lit(PENALTY_DENOMINATOR).cast("bigint"))).otherwise(rounded(x))

    accuracy = accuracy_hundredths.cast("double")
    time = seconds.cast("double")
    value = _checked(time.isNull() | (time < 0) | (time != F.floor(time)),
                     "elapsed seconds must be a nonnegative integer", let(scaled, exact))
    return _checked(accuracy.isNull() | F.isnan(accuracy) | (accuracy < 0) | (accuracy == float("inf")),
                    "accuracy hundredths must be nonnegative and finite", value)


def final_score_from_credit(credit: Column, total: Column, elapsed_ms: Column) -> Column:
    """Exact final score from weighted credit (quarter points), target count and elapsed time.

    All arithmetic is on whole numbers: ``(credit*4*2500*9 - seconds*25*total) / (9*total)``.
    """
    quarters = F.floor(credit * 4 + 0.5).cast("decimal(12,0)")
    targets = total.cast("decimal(10,0)")
    seconds = F.floor(elapsed_ms / 1000).cast("decimal(16,0)")
    numerator = (quarters * (FULL_SCORE // 4 * PENALTY_DENOMINATOR)
                 - seconds * targets * PENALTY_NUMERATOR).cast("decimal(36,0)")
    denominator = (targets * PENALTY_DENOMINATOR).cast("decimal(14,0)")
    bad = (total.isNull() | (total <= 0) | credit.isNull() | F.isnan(credit.cast("double")) | (credit < 0)
           | elapsed_ms.isNull() | F.isnan(elapsed_ms.cast("double")) | (elapsed_ms < 0))
    return _checked(bad, "score needs a positive total and nonnegative credit and time",
                    _half_up(numerator, denominator))


def credit_for(attempt: Column) -> Column:
    """Credit of a correct answer on the given attempt (1, 2 or 3)."""
    return F.element_at(F.array(*[F.lit(c) for c in CREDITS]), attempt.cast("int"))


def accuracy_text(accuracy: Column) -> Column:
    """Percentage with two decimals; a missing accuracy shows as a dash."""
    hundredths = F.round(fixed2(accuracy * 100) * 100).cast("bigint")
    text = F.concat(F.when(hundredths < 0, "-").otherwise(""),
                    F.floor(F.abs(hundredths) / 100).cast("string"), F.lit("."),
                    F.lpad((F.abs(hundredths) % 100).cast("string"), 2, "0"), F.lit("%"))
    return F.when(accuracy.isNull(), F.lit("—")).otherwise(text)


def elapsed_text(elapsed_ms: Column) -> Column:
    """Elapsed time as ``m:ss``."""
    seconds = F.floor(elapsed_ms / 1000)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"),
                    F.lpad((seconds % 60).cast("string"), 2, "0"))


def tier(score: Column) -> Column:
    """Report tier label of a final score."""
    label = F.lit(LOWEST_TIER[0])
    for least, name, _ in reversed(TIERS):
        label = F.when(score >= least, F.lit(name)).otherwise(label)
    return label


def tier_text(score: Column) -> Column:
    """Report tier description of a final score."""
    text = F.lit(LOWEST_TIER[1])
    for least, _, description in reversed(TIERS):
        text = F.when(score >= least, F.lit(description)).otherwise(text)
    return text
