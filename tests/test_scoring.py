import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from atlasrun.functions import scoring
from atlasrun.functions.numbers import fixed2, number_text


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_final_score(spark):
    cases = [(5000.0, 1800, 0), (10000.0, 3600, 0), (10000.0, 0, 10000), (9912.0, 927, 7337), (0.0, 1, 0), (10000.0, 1, 9997),
             (10000.0, 2, 9994), (0.5, 0, 1), (0.4999, 0, 0)]
    got = values(spark, [(a, s) for a, s, _ in cases], "a double, s bigint", scoring.final_score(F.col("a"), F.col("s")))
    assert got == [c[2] for c in cases]


def test_final_score_from_credit(spark):
    cases = [(1.0, 2, 1_800_000.0, 0), (2.0, 3, 0.0, 6667), (0.25, 1, 999.0, 2500), (195.0, 195, 1000.0, 9997)]
    got = values(spark, [c[:3] for c in cases], "c double, t bigint, e double",
                 scoring.final_score_from_credit(F.col("c"), F.col("t"), F.col("e")))
    assert got == [c[3] for c in cases]


def test_final_score_is_exact_for_long_runs(spark):
    pick = random.Random(1)
    cases = [(pick.randrange(0, 4 * 10**6) / 4, pick.randrange(1, 10**6), float(pick.randrange(0, 10**9))) for _ in range(300)]
    got = values(spark, cases, "c double, t bigint, e double", scoring.final_score_from_credit(F.col("c"), F.col("t"), F.col("e")))
    for (credit, total, elapsed), score in zip(cases, got):
        n, d = int(credit * 4) * 2500 * 9 - int(elapsed // 1000) * 25 * total, 9 * total
        assert score == (0 if n <= 0 else (2 * n + d) // (2 * d))


@pytest.mark.parametrize("accuracy,seconds", [(-1.0, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (1.0, -1.0), (1.0, 1.5)])
def test_final_score_rejects(spark, accuracy, seconds):
    with pytest.raises(Exception, match="nonnegative"):
        values(spark, [(accuracy, seconds)], "a double, s double", scoring.final_score(F.col("a"), F.col("s")))


def test_report_texts(spark):
    accuracy = values(spark, [(0.0,), (0.25,), (1 / 3,), (0.5,), (1.0,), (None,)], "a double", scoring.accuracy_text(F.col("a")))
    assert accuracy == ["0.00%", "25.00%", "33.33%", "50.00%", "100.00%", "—"]
    assert values(spark, [(0.0,), (59_999.0,), (61_000.0,), (3_600_000.0,)], "e double", scoring.elapsed_text(F.col("e"))) == [
        "0:00", "0:59", "1:01", "60:00"]
    tiers = values(spark, [(s,) for s in (0, 2499, 2500, 4999, 5000, 7499, 7500)], "s bigint", scoring.tier(F.col("s")))
    assert tiers == ["Keep practicing"] * 2 + ["Keep going"] * 2 + ["Great work"] * 2 + ["Celebration"]


def test_fixed2_uses_the_exact_value(spark):
    pick = random.Random(2)
    numbers = [1.005, -1.005, 0.125, -0.125, 2.675, 1.115, 0.0, 1439.995] + [pick.uniform(-2000, 2000) for _ in range(2000)] \
        + [round(pick.uniform(-50, 50), 3) for _ in range(2000)]
    got = values(spark, [(n,) for n in numbers], "n double", fixed2(F.col("n")))
    for n, rounded in zip(numbers, got):
        assert rounded == float(Decimal(n).quantize(Decimal("0.01"), ROUND_HALF_UP)), n


def test_fixed2_leaves_faults_alone(spark):
    numbers = [math.inf, -math.inf, 1e22, -1e17, 2.0 ** 53, 9e13 + 0.125, None]
    assert values(spark, [(n,) for n in numbers], "n double", fixed2(F.col("n"))) == [
        math.inf, -math.inf, 1e22, -1e17, 2.0 ** 53, float(Decimal(9e13 + 0.125).quantize(Decimal("0.01"), ROUND_HALF_UP)), None]
    assert math.isnan(values(spark, [(math.nan,)], "n double", fixed2(F.col("n")))[0])


def test_final_score_keeps_all_digits_of_the_accuracy(spark):
    # Half a point is reached by the fifteenth decimal only.
    assert values(spark, [(2.499999999999999, 0), (2.5, 0)], "a double, s bigint", scoring.final_score(F.col("a"), F.col("s"))) == [2, 3]


def test_number_text(spark):
    cases = [(3.0, "3"), (0.25, "0.25"), (-1439.12, "-1439.12"), (0.0001, "0.0001"), (-0.0, "0"), (12345678.5, "12345678.5"), (100.0, "100"),
             (12345678.123456, "12345678.123456"), (1e-30, "0." + "0" * 29 + "1"), (1e22, "1" + "0" * 22), (-1.5e300, "-15" + "0" * 299), (120.0, "120"),
             (0.1 + 0.2, "0.30000000000000004"), (1e7, "10000000"), (123456789.0, "123456789")]
    assert values(spark, [(n,) for n, _ in cases], "n double", number_text(F.col("n"))) == [t for _, t in cases]
    assert all(float(t) == n for n, t in cases)
    for bad in (math.nan, math.inf, -math.inf, None):
        with pytest.raises(Exception, match="not a finite number"):
            values(spark, [(bad,)], "n double", number_text(F.col("n")))
