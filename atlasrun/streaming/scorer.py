"""Keyed streaming scorer: the run rules one action at a time, with state per run.

The state holds what the rules need (phase, clock, closed targets, attempts, totals), never past rows.
Every action gives one output row; rejected ones leave the state as it was. Late rows are judged by
the run's own clock; no watermark drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scoring import ATTEMPTS, CREDITS, final_score_from_credit
from ..operators.resolve import resolve_answers

STATE = ("phase string, started_at double, clock double, total bigint, closed bigint, spent bigint, score double, "
         "missed bigint, perfect bigint, eventual bigint, correct bigint, segment bigint, targets array<string>")
IDLE = ("idle", 0.0, 0.0, 0, 0, 0, 0.0, 0, 0, 0, 0)
OUTPUT = ("run_id bigint, quiz_id bigint, segment bigint, seq bigint, event string, reason string, result string, attempt bigint, "
          "credit double, target_pos bigint, correct bigint, completed bigint, remaining bigint, running_accuracy double, "
          "attempts_left bigint, total bigint, score double, missed bigint, perfect bigint, eventually_correct bigint, "
          "elapsed_ms double, completed_at double")
#: Events of a run that leave the state step together.
ROWS = 10_000
COLUMNS = tuple(field.split()[0] for field in OUTPUT.split(", "))


class Run:
    """The rules for one run as a small state machine."""

    FIELDS = ("phase", "started_at", "clock", "total", "closed", "spent", "score", "missed", "perfect", "eventual", "correct")

    def __init__(self, state: tuple | None, implicit_start: float | None):
        values = state if state is not None else (*IDLE, 0, None)
        for name, value in zip((*self.FIELDS, "segment", "targets"), values):
            setattr(self, name, value)
        self.implicit_start = implicit_start

    def state(self) -> tuple:
        return tuple(getattr(self, name) for name in (*self.FIELDS, "segment", "targets"))

    def reset(self) -> None:
        for name, value in zip(self.FIELDS, IDLE):
            setattr(self, name, value)
        self.segment += 1
        self.targets = None

    def _open(self, moment: float, action) -> None:
        """The targets, if the action brings any, and their number hold for the whole segment."""
        self.targets = None if action.targets is None else list(action.targets)
        self.total = self._total(action)
        # A quiz without targets is over as soon as it is open.
        self.phase, self.started_at, self.clock = "active" if self.total > 0 else "completed", moment, moment

    @staticmethod
    def _total(action) -> int:
        if action.targets is not None:
            return len(action.targets)
        return int(action.total) if not pd.isna(action.total) else 0

    def _verdict(self, action) -> bool | None:
        """Is the answer right? None if it names nothing."""
        if self.targets is None:
            return None if action.is_correct is None or pd.isna(action.is_correct) else bool(action.is_correct)
        return None if action.answer_id is None else action.answer_id == self.targets[self.closed]

    def apply(self, action) -> dict:
        """Take or reject one action; the row to emit."""
        kind = action.type
        moment = float(action.ts_ms) if not pd.isna(action.ts_ms) else float("nan")
        timely = moment >= 0 and moment != float("inf")
        if kind == "reset":
            self.reset()
            return self._row("reset")
        if self.phase == "idle" and self.implicit_start is not None:
            self._open(self.implicit_start, action)
        if kind == "start":
            reason = (None if timely else "invalid-timestamp") or {"active": "already-active", "completed": "already-completed"}.get(self.phase) \
                or (None if self._total(action) > 0 else "empty-quiz")
            if reason:
                return self._row("rejected", reason=reason)
            self._open(moment, action)
            return self._row("started")
        if self.phase != "active":
            return self._row("rejected", reason="already-completed" if self.phase == "completed" else "not-started")
        if not timely:
            return self._row("rejected", reason="invalid-timestamp")
        if moment < self.clock:
            return self._row("rejected", reason="non-monotonic-time")
        if kind == "complete-debug":
            self.clock = moment
            self.missed += self.total - self.closed
            self.phase = "completed"
            return self._row("completed", result="missed")
        if kind == "read-elapsed":
            self.clock = moment
            return self._row("elapsed")
        right = self._verdict(action)
        if right is None:
            return self._row("rejected", reason="invalid-answer")
        self.clock = moment
        return self._answer(right)

    def _answer(self, right: bool) -> dict:
        attempt, place = self.spent + 1, self.closed
        credit = CREDITS[attempt - 1] if right else 0.0
        if right:
            self.correct += 1
            self.score += credit
            self.perfect += credit == CREDITS[0]
            self.eventual += credit < CREDITS[0]
        elif attempt == ATTEMPTS:
            self.missed += 1
        closes = right or attempt == ATTEMPTS
        self.closed += closes
        self.spent = 0 if closes else attempt
        if self.closed == self.total:
            self.phase = "completed"
        result = "correct" if right else "missed" if closes else "wrong"
        event = "completed" if self.phase == "completed" else "accepted"
        return self._row(event, result=result, attempt=attempt, credit=credit, place=place)

    def _row(self, event: str, *, reason=None, result=None, attempt=None, credit=None, place=None) -> dict:
        done = event == "completed"
        known = self.phase != "idle"
        return {
            "segment": self.segment, "event": event, "reason": reason, "result": result, "attempt": attempt, "credit": credit,
            "target_pos": place if place is not None else (self.closed if known else None),
            "correct": self.correct, "completed": self.closed, "remaining": self.total - self.closed,
            "running_accuracy": self.score / self.closed if self.closed else 0.0, "attempts_left": ATTEMPTS - self.spent,
            "total": self.total if done else None, "score": self.score if done else None,
            "missed": self.missed if done else None, "perfect": self.perfect if done else None,
            "eventually_correct": self.eventual if done else None,
            "elapsed_ms": self.clock - self.started_at if done else None, "completed_at": self.clock if done else None}


class Action:
    """One action, as :class:`Run` reads it."""

    __slots__ = ("quiz_id", "seq", "type", "ts_ms", "is_correct", "total", "answer_id", "targets")


class Actions:
    """The actions of one run in a trigger: two numbers and a few codes each, however many come, and every value once.

    Chunks come in any order. Columns whose values repeat are held as codes of values, so the memory is about 40 bytes for an action.
    """

    CODED = ("quiz_id", "type", "is_correct", "total", "answer_id", "targets")

    def __init__(self):
        self.seq, self.moment, self.codes = [], [], {c: [] for c in self.CODED}
        self.values = {c: [None] for c in self.CODED}
        self.known = {c: {} for c in self.CODED}

    def _coded(self, name: str, column: pd.Series) -> np.ndarray:
        known, values, out = self.known[name], self.values[name], np.zeros(len(column), np.int32)
        for k, value in enumerate(column):
            if not hasattr(value, "__len__") and pd.isna(value):
                continue
            key = tuple(value) if name == "targets" else value
            code = known.get(key)
            if code is None:
                code = known[key] = len(values)
                values.append(list(key) if name == "targets" else value)
            out[k] = code
        return out

    def add(self, chunk: pd.DataFrame) -> None:
        self.seq.append(np.array(chunk["seq"], np.int64))
        self.moment.append(np.array(pd.to_numeric(chunk["ts_ms"]), np.float64))
        for name in self.CODED:
            self.codes[name].append(self._coded(name, chunk[name]))

    def in_order(self) -> Iterator[Action]:
        """The actions by ``seq``; each is gone with the next."""
        seq, moment = np.concatenate(self.seq), np.concatenate(self.moment)
        codes = {c: np.concatenate(x) for c, x in self.codes.items()}
        self.seq = self.moment = self.codes = None
        order, action = np.argsort(seq, kind="stable"), Action()
        for low in range(0, len(order), ROWS):
            part = order[low:low + ROWS]
            columns = [[self.values[c][k] for k in codes[c][part].tolist()] for c in self.CODED]
            for action.seq, action.ts_ms, *rest in zip(seq[part].tolist(), moment[part].tolist(), *columns):
                action.quiz_id, action.type, action.is_correct, action.total, action.answer_id, action.targets = rest
                yield action


class RunScorer(StatefulProcessor):
    """Applies :class:`Run` to the actions of a run, in ``seq`` order within a batch.

    What a hot run brings in one trigger is held in arrays, and its events leave in frames of ``ROWS``. With ``latest`` only the last status of a trigger leaves.
    With ``keep_ms``, the state of a run is dropped that long after its last action.
    """

    def __init__(self, implicit_start: float | None = None, keep_ms: int | None = None, latest: bool = False):
        self.implicit_start, self.keep_ms, self.latest = implicit_start, keep_ms, latest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        actions = Actions()
        for chunk in rows:
            actions.add(chunk)
        run = Run(self.run.get() if self.run.exists() else None, self.implicit_start)
        emitted: list[tuple] = []
        for action in actions.in_order():
            row = {"run_id": key[0], "quiz_id": action.quiz_id, "seq": action.seq, **run.apply(action)}
            if self.latest:
                if row["attempt"] is not None:
                    emitted = [tuple(map(row.__getitem__, COLUMNS))]
                continue
            emitted.append(tuple(map(row.__getitem__, COLUMNS)))
            if len(emitted) == ROWS:
                yield _frame(emitted)
                emitted = []
        self.run.update(run.state())
        if emitted:
            yield _frame(emitted)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Object columns keep whole numbers beside missing ones; Arrow gives them their types."""
    return pd.DataFrame({c: pd.Series(values, dtype=object) for c, values in zip(COLUMNS, zip(*rows))})


def score_stream(actions: DataFrame, implicit_start: float | None = None, keep_ms: int | None = None, latest: bool = False) -> DataFrame:
    """Events of a stream of actions (``run_id, quiz_id, seq, type, ts_ms, is_correct, total``).

    Actions with ``answer_id`` and ``targets`` (see :func:`score_answers`) are judged here, by the target then open.
    What a start action says of targets or total holds until the next reset. ``keep_ms`` limits how long the state
    of a run is kept after its last action; without it, state stays. ``latest`` is for :func:`live`.
    """
    has = set(actions.columns)

    def given(name: str, kind: str):
        return (F.col(name) if name in has else F.lit(None)).cast(kind).alias(name)

    needed = actions.select("run_id", "quiz_id", "seq", "type", F.col("ts_ms").cast("double").alias("ts_ms"), given("is_correct", "boolean"), given("total", "bigint"),
                            given("answer_id", "string"), given("targets", "array<string>"))
    events = needed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunScorer(implicit_start, keep_ms, latest), outputStructType=OUTPUT, outputMode="Update" if latest else "Append", timeMode="ProcessingTime" if keep_ms else "None")
    ended = F.col("event") == "completed"
    return events.withColumns({
        "accuracy": F.when(ended, F.col("score") / F.col("total")),
        "final_score": F.when(ended, final_score_from_credit(F.col("score"), F.col("total"), F.col("elapsed_ms")))})


def score_answers(actions: DataFrame, scoped: DataFrame, orders: DataFrame, implicit_start: float | None = None, keep_ms: int | None = None) -> DataFrame:
    """Events of a stream of raw answers (``selected_id, text``) with the target order of each run.

    Answers are resolved by id or name key against ``scoped`` (``quiz_id, location_id, name, pos``), and ``orders``
    (``run_id, targets``) brings the targets, both as joins with tables before the state step. Targets travel only
    with the rows that can open a run.
    """
    resolved = resolve_answers(actions, scoped).join(orders.select("run_id", "targets"), "run_id", "left")
    opener = F.lit(True) if implicit_start is not None else F.col("type") == "start"
    return score_stream(resolved.withColumn("targets", F.when(opener, F.col("targets"))), implicit_start, keep_ms)


def rejected(events: DataFrame) -> DataFrame:
    """Side output: rejected actions with the reason."""
    return events.where(F.col("event") == "rejected").select("run_id", "segment", "seq", "reason")


def completed(events: DataFrame) -> DataFrame:
    """Results of completed runs."""
    return events.where(F.col("event") == "completed").select(
        "run_id", "segment", "quiz_id", "total", "score", "accuracy", "missed", "perfect", "eventually_correct",
        "elapsed_ms", "completed_at", "final_score")


def status(events: DataFrame) -> DataFrame:
    """Live run status after each taken answer."""
    return events.where(F.col("attempt").isNotNull()).select(
        "run_id", "segment", "seq", "correct", "completed", "remaining", F.col("running_accuracy").alias("accuracy"), "attempts_left")


def live(actions: DataFrame, implicit_start: float | None = None, keep_ms: int | None = None) -> DataFrame:
    """Live run status in update mode: the current row of each run that a trigger has changed. See :mod:`.live`."""
    return status(score_stream(actions, implicit_start, keep_ms, latest=True))
