"""Timed-attempt logs: which rows count, what each attempt earns, and the result of each run.

An action log has one row per action: ``run_id``, ``seq`` (whole number, unique in the run), ``type``
(``start``, ``submit``, ``read-elapsed``, ``complete-debug``, ``reset``), ``ts_ms``, ``total`` (targets of
the run) and, for submits, ``is_correct`` (null when the answer names nothing in scope). Logs that
carry answers instead of verdicts go through :func:`judge_answers` first.

All rules are running sums and maxima over blocks of a run (see :mod:`.prefix`), so a run of any
length is spread over many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.scoring import ATTEMPTS, CREDITS, credit_for, final_score_from_credit
from ..session import cut_lineage
from .prefix import BLOCK, BLOCK_SIZE, block_window, earlier_blocks, running_before, with_blocks
from .resolve import resolve_answers

RUN = ["run_id"]
SEGMENT = ["run_id", "segment"]


def valid_time(ts: Column) -> Column:
    """Is the timestamp finite and not negative?"""
    moment = ts.cast("double")
    return moment.isNotNull() & ~F.isnan(moment) & (F.abs(moment) != float("inf")) & (moment >= 0)


def run_clock(actions: DataFrame, *, resets: bool = True, implicit_start_ms: int | None = None,
              block_size: int = BLOCK_SIZE) -> DataFrame:
    """Add what a row finds when it arrives: ``segment``, ``has_started``, ``started_at`` and ``clock``; ``total`` becomes
    that of the segment's start action (of the row itself before a start or with an implicit one; null is 0).

    A segment is a stretch of a run between resets; it starts with its first acceptable start action
    (or, with ``implicit_start_ms``, at that time without one). The clock is the latest accepted time:
    only accepted rows move it, and a row that is late is below the running maximum of the rows that
    could move it, so that maximum is the latest accepted time.

    Within a block all this is windows. From one block to the next only the open segment counts: its
    start, its latest time, and how many resets came before.
    """
    moment = F.col("ts_ms").cast("double")
    moves = valid_time(F.col("ts_ms")) & (F.col("type").isin("read-elapsed", "complete-debug")
                                          | ((F.col("type") == "submit") & F.col("is_correct").isNotNull()))
    forces = (F.col("type") == "complete-debug") & F.col("has_started") & valid_time(F.col("ts_ms")) & (moment >= F.col("clock"))
    forced_at = F.when(forces, F.col("seq"))
    if implicit_start_ms is not None and not resets:
        # One segment, open from the beginning: only the latest time comes from earlier rows.
        rows = running_before(with_blocks(actions, "seq", block_size), RUN, "seq", {"_latest": ("max", F.when(moves, moment))})
        started = F.lit(float(implicit_start_ms))
        return rows.withColumns({"segment": F.lit(0).cast("bigint"), "has_started": F.lit(True), "started_at": started,
                                 "clock": F.greatest(started, F.col("_latest")),
                                 "total": F.coalesce(F.col("total").cast("bigint"), F.lit(0).cast("bigint"))}).drop("_latest").withColumn("_forces", forced_at)
    opens = (F.col("type") == "start") & valid_time(F.col("ts_ms")) & (F.coalesce(F.col("total"), F.lit(0)) > 0)
    total = F.col("total").cast("bigint")
    opening = F.when(opens, F.struct("seq", moment.alias("at"), total.alias("total")))
    if implicit_start_ms is not None:
        # As if every segment began with a start action before its first row.
        opening = F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit(float(implicit_start_ms)).alias("at"), F.lit(None).cast("bigint").alias("total"))
    rows = with_blocks(actions, "seq", block_size)
    block = block_window(RUN, "seq")
    is_reset = F.when(F.col("type") == "reset", 1).otherwise(0)
    piece = F.sum(is_reset).over(block.rowsBetween(Window.unboundedPreceding, 0)) if resets else F.lit(0).cast("bigint")
    rows = rows.withColumn("_piece", piece)
    in_piece = Window.partitionBy(*RUN, BLOCK, "_piece").orderBy("seq")
    before = in_piece.rowsBetween(Window.unboundedPreceding, -1)
    known_start = opening if implicit_start_ms is not None else F.min(opening).over(before)
    rows = rows.withColumns({"_first": known_start, "_moved": F.when(moves, moment)})
    rows = rows.withColumn("_moved_on", F.when(F.col("_first").isNotNull(), F.col("_moved")))
    rows = rows.withColumns({"_opening": opening, "_any": F.max("_moved").over(before), "_after": F.max("_moved_on").over(before)})

    pieces = rows.groupBy(*RUN, BLOCK, "_piece").agg(
        F.min("_opening").alias("start"), F.max("_moved").alias("any"), F.max("_moved_on").alias("after"))
    blocks = pieces.groupBy(*RUN, BLOCK).agg(F.max("_piece").alias("_resets"),
                                             F.max_by(F.struct("start", "any", "after"), "_piece").alias("_last"))
    order = Window.partitionBy(*RUN).orderBy(BLOCK)
    blocks = blocks.withColumn("_stretch", F.sum(F.when(F.col("_resets") > 0, 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy(*RUN, "_stretch").orderBy(BLOCK)
    start_by = F.first("_last.start", ignorenulls=True)
    blocks = blocks.withColumns({
        "_start": start_by.over(stretch.rowsBetween(Window.unboundedPreceding, 0)),
        "_gain": F.when(start_by.over(stretch.rowsBetween(Window.unboundedPreceding, -1)).isNotNull(), F.col("_last.any"))
        .otherwise(F.col("_last.after"))})
    blocks = blocks.withColumn("_clock", F.max("_gain").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
    carry = blocks.select(*RUN, BLOCK, F.lag("_start").over(order).alias("_in_start"), F.lag("_clock").over(order).alias("_in_clock"),
                          F.coalesce(F.sum("_resets").over(earlier_blocks(RUN)), F.lit(0)).alias("_in_segment"))

    rows = rows.join(carry, [*RUN, BLOCK])
    continues = (F.col("_piece") == 0) & F.col("_in_start").isNotNull()
    start = F.when(continues, F.col("_in_start")).otherwise(F.col("_first"))
    latest = F.when(continues, F.greatest("_in_clock", "_any")).otherwise(F.col("_after"))
    rows = rows.withColumns({"segment": (F.col("_in_segment") + F.col("_piece")).cast("bigint"), "has_started": start.isNotNull(),
                             "started_at": start["at"], "clock": F.greatest(start["at"], latest),
                             "total": F.coalesce(start["total"], total, F.lit(0).cast("bigint"))})
    return rows.withColumn("_forces", forced_at).drop(
        "_piece", "_first", "_moved", "_moved_on", "_opening", "_any", "_after", "_in_start", "_in_clock", "_in_segment")


def reason_before_answers(rows: DataFrame) -> DataFrame:
    """Add ``gate_reason``: why the row is rejected if the run is still active, else null."""
    moment = F.col("ts_ms").cast("double")
    return rows.withColumn(
        "gate_reason",
        F.when(F.col("type") == "reset", F.lit(None).cast("string"))
        .when(F.col("type") == "start",
              F.when(~valid_time(F.col("ts_ms")), "invalid-timestamp")
              .when(F.col("has_started"), "already-active")
              .when(F.coalesce(F.col("total"), F.lit(0)) <= 0, "empty-quiz"))
        .when(~F.col("has_started"), "not-started")
        .when(~valid_time(F.col("ts_ms")), "invalid-timestamp")
        .when(moment < F.col("clock"), "non-monotonic-time")
        .when((F.col("type") == "submit") & F.col("is_correct").isNull(), "invalid-answer"))


def number_attempts(rows: DataFrame) -> DataFrame:
    """Add attempt, credit and target position of each countable answer, block by block.

    A target closes with a correct answer or its third wrong one. Within a stretch of answers after
    a correct one, the n-th answer is attempt ``(n-1) % 3 + 1``. A block depends on earlier blocks
    only through the number of attempts already spent on the open target, which is what the carry
    holds, next to the closed targets, correct answers and credit so far.
    """
    counts = (F.col("type") == "submit") & F.col("gate_reason").isNull() & F.col("has_started")
    forces = F.col("_forces").isNotNull()
    window = block_window(SEGMENT, "seq")
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    correct = counts & F.col("is_correct")
    rows = rows.withColumns({"_counts": counts, "_correct": F.coalesce(correct, F.lit(False)),
                             "_n": F.count(F.when(counts, 1)).over(so_far)})
    rows = rows.withColumn("_last", F.max(F.when(F.col("_correct"), F.col("_n"))).over(before))
    later = F.col("_counts") & F.col("_last").isNotNull()
    spent = F.col("_n") - F.col("_last")
    closes_later = later & (F.col("_correct") | (spent % ATTEMPTS == 0))
    earns_later = F.when(later & F.col("_correct"), credit_for((spent - 1) % ATTEMPTS + 1)).otherwise(0.0)

    keys = [*SEGMENT, BLOCK]
    totals = rows.groupBy(*keys).agg(
        F.count(F.when(F.col("_counts"), 1)).alias("_answers"),
        F.max(F.when(F.col("_correct"), F.col("_n"))).alias("_last_n"),
        F.min(F.when(F.col("_correct"), F.col("_n"))).alias("_first_n"),
        F.count(F.when(closes_later, 1)).alias("_closes_later"),
        F.count(F.when(F.col("_correct"), 1)).alias("_corrects"),
        F.sum(earns_later).alias("_earns_later"),
        F.min("_forces").alias("_force"),
    )
    past = earlier_blocks(SEGMENT)
    totals = totals.withColumn("_past", F.coalesce(F.sum("_answers").over(past), F.lit(0)))
    totals = totals.withColumn("_past_last", F.max(F.col("_past") + F.col("_last_n")).over(past))
    totals = totals.withColumn("_open", (F.col("_past") - F.coalesce(F.col("_past_last"), F.lit(0))) % ATTEMPTS)
    wrongs = F.col("_open") + F.coalesce(F.col("_first_n") - 1, F.col("_answers"))
    closes = F.floor(wrongs / ATTEMPTS) + F.when(F.col("_first_n").isNotNull(), 1).otherwise(0) + F.col("_closes_later")
    earns = F.when(F.col("_first_n").isNotNull(), credit_for(wrongs % ATTEMPTS + 1)).otherwise(0.0) + F.col("_earns_later")
    carry = totals.select(
        *keys, "_open",
        F.coalesce(F.sum(closes).over(past), F.lit(0)).alias("_closed_past"),
        F.coalesce(F.sum("_corrects").over(past), F.lit(0)).alias("_correct_past"),
        F.coalesce(F.sum(earns).over(past), F.lit(0.0)).alias("_score_past"),
        F.min("_force").over(past).alias("_force_past"))

    rows = rows.join(carry, keys)
    place = F.when(F.col("_last").isNull(), F.col("_open") + F.col("_n")).otherwise(spent)
    rows = rows.withColumn("_attempt", F.when(F.col("_counts"), (place - 1) % ATTEMPTS + 1).cast("int"))
    closes_row = F.col("_counts") & (F.col("_correct") | (F.col("_attempt") == ATTEMPTS))
    rows = rows.withColumns({
        "_closes": F.coalesce(closes_row, F.lit(False)),
        "_credit": F.when(F.col("_correct"), credit_for(F.col("_attempt"))).when(F.col("_counts"), 0.0)})
    zero = F.lit(0)
    rows = rows.withColumns({
        "closed_before": F.col("_closed_past") + F.coalesce(F.count(F.when(F.col("_closes"), 1)).over(before), zero),
        "correct_before": F.col("_correct_past") + F.coalesce(F.count(F.when(F.col("_correct"), 1)).over(before), zero),
        "score_before": F.col("_score_past") + F.coalesce(F.sum("_credit").over(before), F.lit(0.0)),
        "forced_before": F.least("_force_past", F.min("_forces").over(before)).isNotNull()})
    return rows.drop("_n", "_last", "_open", "_closed_past", "_correct_past", "_score_past", "_force_past")


def replay(actions: DataFrame, *, resets: bool = True, implicit_start_ms: int | None = None,
           block_size: int = BLOCK_SIZE) -> DataFrame:
    """Apply all rules to an action log and give each row its event.

    Adds ``segment``, ``event`` (``started``, ``elapsed``, ``accepted``, ``completed``, ``reset``,
    ``rejected``), ``reason``, ``result`` (``wrong``, ``correct``, ``missed``), ``attempt``, ``credit``,
    ``target_pos`` (targets closed before the row) and the run state before the row.
    """
    if "is_correct" not in actions.columns:
        raise ValueError("actions need is_correct; see judge_answers")
    rows = run_clock(actions, resets=resets, implicit_start_ms=implicit_start_ms, block_size=block_size)
    rows = number_attempts(reason_before_answers(rows))
    done = F.col("has_started") & ((F.col("closed_before") >= F.col("total")) | F.col("forced_before"))
    reason = (F.when(F.col("type") == "reset", F.lit(None).cast("string"))
              .when((F.col("type") == "start") & (F.col("gate_reason") == "already-active") & done, "already-completed")
              .when(F.col("type") == "start", F.col("gate_reason"))
              .when(done, "already-completed")
              .otherwise(F.col("gate_reason")))
    rows = rows.withColumn("reason", reason)
    taken = F.col("reason").isNull()
    answer = taken & F.col("_counts")
    finishes = (answer & F.col("_closes") & (F.col("closed_before") + 1 >= F.col("total"))) \
        | (taken & F.col("_forces").isNotNull())
    event = (F.when(~taken, "rejected").when(F.col("type") == "reset", "reset").when(F.col("type") == "start", "started")
             .when(finishes, "completed").when(F.col("type") == "read-elapsed", "elapsed").otherwise("accepted"))
    result = (F.when(taken & F.col("_forces").isNotNull(), "missed")
              .when(answer & F.col("_correct"), "correct")
              .when(answer & F.col("_closes"), "missed").when(answer, "wrong"))
    rows = rows.withColumns({
        "event": event, "result": result,
        "attempt": F.when(answer, F.col("_attempt")),
        "credit": F.when(answer, F.col("_credit")),
        "closes": answer & F.col("_closes"),
        "target_pos": F.when(F.col("has_started"), F.least("closed_before", "total")).cast("bigint")})
    return rows.drop(BLOCK, "_counts", "_correct", "_closes", "_credit", "_attempt", "_forces", "gate_reason")


def live_status(replayed: DataFrame) -> DataFrame:
    """Run status after each taken answer: correct, completed, remaining, accuracy, attempts left."""
    closes = F.col("closes").cast("int")
    completed = F.col("closed_before") + closes
    correct = F.col("correct_before") + F.when(F.col("result") == "correct", 1).otherwise(0)
    score = F.col("score_before") + F.coalesce(F.col("credit"), F.lit(0.0))
    return replayed.where(F.col("attempt").isNotNull()).select(
        "run_id", "segment", "seq",
        correct.cast("bigint").alias("correct"), completed.cast("bigint").alias("completed"),
        (F.col("total") - completed).cast("bigint").alias("remaining"),
        F.when(completed > 0, score / completed).otherwise(0.0).alias("accuracy"),
        F.when(F.col("closes"), ATTEMPTS).otherwise(ATTEMPTS - F.col("attempt")).cast("bigint").alias("attempts_left"))


def outcomes(replayed: DataFrame) -> DataFrame:
    """One row per closed target: attempts, status and credit."""
    return replayed.where("closes").select(
        "run_id", "segment", F.col("target_pos").alias("target_pos"),
        F.col("attempt").cast("bigint").alias("attempts"),
        F.when(F.col("result") == "correct", "correct").otherwise("missed").alias("status"), "credit")


def run_summary(replayed: DataFrame) -> DataFrame:
    """Totals of each started segment, finished or not; partial sums keep the shuffle small."""
    taken = F.col("reason").isNull()
    keep = [c for c in ("quiz_id",) if c in replayed.columns]
    return (replayed.where(F.col("has_started") | (F.col("event") == "started"))
            .groupBy("run_id", "segment", *keep)
            .agg(F.max("total").cast("bigint").alias("total"),
                 F.coalesce(F.sum("credit"), F.lit(0.0)).alias("score"),
                 F.count(F.when(F.col("closes"), 1)).alias("closed"),
                 F.count(F.when(F.col("closes") & (F.col("result") == "missed"), 1)).alias("missed_closed"),
                 F.count(F.when(F.col("credit") == CREDITS[0], 1)).alias("perfect"),
                 F.count(F.when((F.col("credit") > 0) & (F.col("credit") < CREDITS[0]), 1)).alias("eventually_correct"),
                 F.min(F.when(F.col("event") == "started", F.col("ts_ms").cast("double"))
                       .otherwise(F.col("started_at"))).alias("started_at"),
                 F.max(F.when(F.col("event") == "completed", F.col("ts_ms").cast("double"))).alias("completed_at"),
                 F.max(F.when(taken & F.col("type").isin("submit", "read-elapsed"), F.col("ts_ms").cast("double")))
                 .alias("last_at")))


def run_results(replayed: DataFrame) -> DataFrame:
    """Results of the completed segments, with the exact final score."""
    done = run_summary(replayed).where(F.col("completed_at").isNotNull())
    return _with_results(done, F.col("completed_at"))


def force_complete(replayed: DataFrame, extra_ms: float = 0.0) -> DataFrame:
    """Results with every open run closed: its remaining targets count as missed.

    An open run ends ``extra_ms`` after its latest accepted action.
    """
    summary = run_summary(replayed)
    latest = F.coalesce(F.col("last_at"), F.col("started_at"))
    return _with_results(summary, F.coalesce(F.col("completed_at"), latest + F.lit(float(extra_ms))))


def remaining_outcomes(replayed: DataFrame) -> DataFrame:
    """Outcome rows that forcing an open run would add: third attempt, missed, no credit."""
    still_open = run_summary(replayed).where(F.col("closed") < F.col("total"))
    places = F.explode(F.sequence(F.col("closed"), F.col("total") - 1)).alias("target_pos")
    return still_open.select("run_id", "segment", places).select(
        "run_id", "segment", "target_pos", F.lit(ATTEMPTS).cast("bigint").alias("attempts"),
        F.lit("missed").alias("status"), F.lit(0.0).alias("credit"))


def _with_results(summary: DataFrame, completed_at: Column) -> DataFrame:
    elapsed = completed_at - F.col("started_at")
    keep = [c for c in ("quiz_id",) if c in summary.columns]
    return summary.select(
        "run_id", "segment", *keep, "total", "score",
        (F.col("score") / F.col("total")).alias("accuracy"),
        (F.col("missed_closed") + F.col("total") - F.col("closed")).alias("missed"),
        "perfect", "eventually_correct", elapsed.alias("elapsed_ms"), completed_at.alias("completed_at"),
        final_score_from_credit(F.col("score"), F.col("total"), elapsed).alias("final_score"))


#: How a target was closed, as a letter: the verdicts of the answers it took; the last two are of targets still open.
_TAKEN = {"1": (True,), "2": (False, True), "3": (False, False, True), "0": (False, False, False), "a": (False,), "b": (False, False)}


def _closed_target(state: Column, number: Column) -> Column:
    """One target of a segment: how many answers it takes, from the place the last one left off. The state stays a place and a letter for each target."""
    target, left = F.get(F.col("targets"), number), F.size("answers") - state["place"]

    def right(k: int) -> Column:
        return F.get(F.col("answers"), state["place"] + k)["answer_id"].eqNullSafe(target)

    letter = (F.when(left <= 0, "").when(right(0), "1").when(left == 1, "a").when(right(1), "2").when(left == 2, "b").when(right(2), "3").otherwise("0"))
    return let(letter, lambda c: F.struct(
        (state["place"] + F.when(c == "", 0).when(c.isin("1", "a"), 1).when(c.isin("2", "b"), 2).otherwise(ATTEMPTS)).alias("place"), F.concat(state["closed"], c).alias("closed")))


def _verdicts(closed: Column) -> Column:
    """The verdicts of a segment's answers in order, from the letters of its targets."""
    taken = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in _TAKEN.items() for x in pair))
    letters = F.filter(F.split(closed, ""), lambda c: c != "")
    return F.flatten(F.transform(letters, lambda c: F.element_at(taken, c)))


def judge_answers(actions: DataFrame, orders: DataFrame, block_size: int = BLOCK_SIZE,
                  implicit_start_ms: int | None = None, resets: bool = True) -> DataFrame:
    """Turn a log of answers into one with verdicts, given the target order of each segment.

    ``actions`` carries ``answer_id`` (null when it resolves to nothing); ``orders`` has ``run_id``,
    ``segment`` and the array ``targets``. Whether an answer is right depends on the target then open,
    which depends on all earlier answers. A run is over after at most three answers per target, so
    after the time gate only that many rows of a segment can matter; they are gathered into one row
    and walked target by target, and later answers only need to be known as valid.
    """
    rows = actions.withColumn("is_correct", F.when(F.col("answer_id").isNotNull(), F.lit(False)))
    rows = reason_before_answers(run_clock(rows, resets=resets, implicit_start_ms=implicit_start_ms, block_size=block_size))
    valid = (F.col("type") == "submit") & F.col("gate_reason").isNull() & F.col("has_started")
    rows = running_before(rows, SEGMENT, "seq", {"_earlier": ("sum", F.when(valid, 1).otherwise(0))})
    deciding = (rows.where(valid & (F.col("_earlier") < F.col("total") * ATTEMPTS))
                .groupBy(*SEGMENT)
                .agg(F.array_sort(F.collect_list(F.struct("seq", "answer_id"))).alias("answers")))
    by = SEGMENT if "segment" in orders.columns else RUN  # without segments, the order holds for all of a run
    folded = F.aggregate(F.sequence(F.lit(0), F.size("targets") - 1), F.struct(F.lit(0).alias("place"), F.lit("").alias("closed")), _closed_target)["closed"]
    closed = F.when(F.size("targets") > 0, folded).otherwise("")
    verdicts = (deciding.join(orders.select(*by, "targets"), by)
                .select("run_id", "answers", _verdicts(closed).alias("verdicts"))
                .select("run_id", F.explode(F.zip_with(F.slice("answers", F.lit(1), F.size("verdicts")), "verdicts", lambda answer, right: F.struct(
                    answer["seq"].cast("bigint").alias("seq"), right.alias("_verdict")))).alias("v"))
                .select("run_id", "v.seq", "v._verdict"))
    known = actions.join(verdicts, ["run_id", "seq"], "left")
    return known.withColumn(
        "is_correct", F.coalesce(F.col("_verdict"), F.when(F.col("answer_id").isNotNull(), F.lit(False)))
    ).drop("_verdict")


def answers_to_results(actions: DataFrame, scoped: DataFrame, orders: DataFrame, *, resets: bool = True,
                       implicit_start_ms: int | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Results of completed runs from raw answers (``quiz_id, selected_id, text``), as they would go to the boards.

    Answers are resolved in their quiz (``scoped``), judged by the target order of the run (``orders`` has ``run_id`` and
    ``targets``, whose number is the run's total), and replayed.
    """
    resolved = resolve_answers(actions.drop("total"), scoped).join(
        orders.select("run_id", F.size("targets").cast("bigint").alias("total")), "run_id", "left")
    judged = cut_lineage(judge_answers(resolved, orders, block_size, implicit_start_ms, resets))
    return run_results(replay(judged, resets=resets, implicit_start_ms=implicit_start_ms, block_size=block_size))


def seeded_draws(seed: int, key: Column, count: Column) -> Column:
    """``count`` repeatable draws in [0, 1) for a key: the first 32 bits of an MD5 per draw."""
    def draw(place: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), place.cast("string")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), draw)).otherwise(F.array().cast("array<double>"))


def _places(sizes: pd.Series, draws: pd.Series) -> pd.Series:
    """For each array the places of its items after all swaps."""
    out = []
    for size, drawn in zip(sizes, draws):
        order = list(range(int(size)))
        for turn, last in enumerate(range(len(order) - 1, 0, -1)):
            draw = drawn[turn] if drawn is not None and turn < len(drawn) else None
            if draw is None or not 0 <= draw < 1:
                raise ValueError("draws must be finite and in [0, 1)")
            pick = int(draw * (last + 1))
            order[last], order[pick] = order[pick], order[last]
        out.append(order)
    return pd.Series(out, dtype=object)


def shuffle_ids(ids: Column, draws: Column) -> Column:
    """Permute an id array: from the last place down, swap with the place its draw picks.

    Each swap depends on all before it, and column functions copy the array for each; so the places come from a small Arrow function, linear in
    their number.
    """
    size = F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0))
    places = F.pandas_udf(_places, "array<int>")(size, draws)
    return F.when(ids.isNotNull(), F.transform(places, lambda place: F.get(ids, place)))
