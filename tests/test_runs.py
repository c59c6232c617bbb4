import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from atlasrun.operators import runs
from atlasrun.streaming.scorer import Run

SCHEMA = "run_id bigint, quiz_id bigint, seq bigint, type string, ts_ms double, is_correct boolean, total bigint"


def random_log(seed, run_count=12, length=90, kinds="full"):
    pick = random.Random(seed)
    rows = []
    for run in range(run_count):
        clock, total = 0.0, pick.choice([0, 1, 2, 3, 5]) if kinds == "full" else 4
        size = length * 8 if run == 0 else length
        for seq in range(size):
            clock += pick.choice([0, 1, 5, -7])
            moment = pick.choice([clock] * 12 + [float("nan"), -3.0, float("inf")])
            kind = pick.choices(["start", "submit", "read-elapsed", "complete-debug", "reset"],
                                [3, 20, 4, 0.5, 1] if kinds == "full" else [0, 20, 4, 0, 0])[0]
            correct = pick.choice([True, False, False, None]) if kind == "submit" else None
            rows.append((run, run % 3, seq, kind, moment, correct, total))
    return rows


def expected_events(rows, implicit=None):
    machines, out = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[2])):
        action = SimpleNamespace(run_id=row[0], quiz_id=row[1], seq=row[2], type=row[3], ts_ms=row[4], is_correct=row[5], total=row[6], targets=None, answer_id=None)
        event = machines.setdefault(row[0], Run(None, implicit)).apply(action)
        out[row[0], row[2]] = (event["segment"], event["event"], event["reason"], event["result"], event["attempt"], event["credit"])
    return out


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1 << 20), (3, 1), (4, 40)])
def test_rules_equal_the_state_machine(spark, seed, block):
    rows = random_log(seed)
    got = runs.replay(spark.createDataFrame(rows, SCHEMA), block_size=block).collect()
    mine = {(r.run_id, r.seq): (r.segment, r.event, r.reason, r.result, r.attempt, r.credit) for r in got}
    assert len(got) == len(rows)
    assert mine == expected_events(rows)


def test_implicit_start_and_status(spark):
    rows = random_log(5, kinds="answers")
    replayed = runs.replay(spark.createDataFrame(rows, SCHEMA), resets=False, implicit_start_ms=0, block_size=13).cache()
    mine = {(r.run_id, r.seq): (r.segment, r.event, r.reason, r.result, r.attempt, r.credit) for r in replayed.collect()}
    assert mine == expected_events(rows, 0.0)
    machines, want = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[2])):
        action = SimpleNamespace(type=row[3], ts_ms=row[4], is_correct=row[5], total=row[6], targets=None, answer_id=None)
        event = machines.setdefault(row[0], Run(None, 0.0)).apply(action)
        if event["attempt"] is not None:
            want[row[0], row[2]] = (event["correct"], event["completed"], event["remaining"], event["running_accuracy"], event["attempts_left"])
    got = {(r.run_id, r.seq): (r.correct, r.completed, r.remaining, r.accuracy, r.attempts_left) for r in runs.live_status(replayed).collect()}
    assert got == want


def test_literal_run(spark):
    answers = [False, True, True, False, False, False]
    rows = [(1, 1, 0, "start", 1000.0, None, 3)] + [(1, 1, i + 1, "submit", 1000.0 + i, a, 3) for i, a in enumerate(answers)] \
        + [(1, 1, 9, "submit", 5000.0, True, 3), (1, 1, 10, "start", 9000.0, None, 3)]
    replayed = runs.replay(spark.createDataFrame(rows, SCHEMA))
    result = runs.run_results(replayed).first()
    assert (result.score, result.missed, result.perfect, result.eventually_correct, result.elapsed_ms, result.final_score) == (1.5, 1, 1, 1, 5.0, 5000)
    late = [r.reason for r in replayed.where("seq >= 9").orderBy("seq").collect()]
    assert late == ["already-completed", "already-completed"]


def test_force_complete_counts_the_rest_as_missed(spark):
    rows = [(1, 1, 0, "start", 0.0, None, 4), (1, 1, 1, "submit", 10.0, True, 4), (1, 1, 2, "read-elapsed", 20.0, None, 4),
            (2, 1, 0, "start", 0.0, None, 4), (2, 1, 1, "submit", 10.0, True, 4), (2, 1, 2, "complete-debug", 600_010.0, None, 4)]
    replayed = runs.replay(spark.createDataFrame(rows, SCHEMA))
    forced = {r.run_id: (r.missed, r.elapsed_ms) for r in runs.force_complete(replayed, 600_000).collect()}
    assert forced == {1: (3, 600_020.0), 2: (3, 600_010.0)}
    assert [r.run_id for r in runs.run_results(replayed).collect()] == [2]
    left = runs.remaining_outcomes(replayed).where("run_id = 1").orderBy("target_pos").collect()
    assert [(r.target_pos, r.attempts, r.status, r.credit) for r in left] == [(k, 3, "missed", 0.0) for k in (1, 2, 3)]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_judged_answers_equal_a_replay(spark, block):
    pick = random.Random(9)
    rows, orders, verdicts = [], [], {}
    for run in range(10):
        targets = pick.sample("abcdef", 4)
        orders.append((run, 0, targets))
        clock, place, spent, at = 0.0, 0, 0, 0.0
        for seq in range(60 if run else 500):
            at += pick.choice([1, 2, -3])
            answer = pick.choice([None, *"abcdef", *targets])
            rows.append((run, 1, seq, "submit", at, answer, 4))
            if answer is None or at < clock or at < 0:
                continue
            clock = at
            if place < 4:
                right = answer == targets[place]
                verdicts[run, seq] = right
                spent += 1
                if right or spent == 3:
                    place, spent = place + 1, 0
    actions = spark.createDataFrame(rows, "run_id bigint, quiz_id bigint, seq bigint, type string, ts_ms double, answer_id string, total bigint")
    order = spark.createDataFrame(orders, "run_id bigint, segment bigint, targets array<string>")
    judged = runs.judge_answers(actions, order, block_size=block, implicit_start_ms=0, resets=False)
    replayed = runs.replay(judged, resets=False, implicit_start_ms=0, block_size=block)
    got = {(r.run_id, r.seq): r.result == "correct" for r in replayed.where("attempt is not null").collect()}
    assert got == verdicts


def test_shuffle(spark):
    ids = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(runs.shuffle_ids(ids, zero)).first()[0] == ["b", "c", "a"]
    with pytest.raises(Exception, match="draws must be finite"):
        spark.range(1).select(runs.shuffle_ids(ids, F.array(F.lit(1.0), F.lit(0.0)))).collect()
    many = F.sequence(F.lit(1), F.lit(50))
    mixed = spark.range(20).select(runs.shuffle_ids(many, runs.seeded_draws(3, F.col("id"), F.size(many) - 1)).alias("s")).collect()
    assert all(sorted(r.s) == list(range(1, 51)) for r in mixed) and len({tuple(r.s) for r in mixed}) == 20


def test_shuffles_are_linear(spark):
    import time

    from pyspark.sql import functions as F

    ids = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda k: k.cast("string")).alias("ids"))
    began = time.perf_counter()
    row = ids.select("ids", runs.shuffle_ids(F.col("ids"), runs.seeded_draws(3, F.lit("run"), F.size("ids") - 1)).alias("out")).first()
    assert sorted(row.out) == sorted(row.ids) and row.out != row.ids and time.perf_counter() - began < 30


def test_many_targets_are_judged(spark):
    """A segment of thousands of targets against a plain walk."""
    import random

    r = random.Random(4)
    targets = [f"t{k}" for k in range(4000)]
    place, spent, rows, want = 0, 0, [], {}
    for seq in range(9000):
        answer = targets[place] if place < len(targets) and r.random() < 0.45 else r.choice(targets)
        rows.append((1, seq, "submit", float(seq), None, len(targets), answer))
        if place < len(targets):
            right = answer == targets[place]
            want[seq] = right
            spent = 0 if right or spent == 2 else spent + 1
            place += spent == 0
    log = spark.createDataFrame(rows, "run_id long, seq long, type string, ts_ms double, is_correct boolean, total long, answer_id string")
    orders = spark.createDataFrame([(1, targets)], "run_id long, targets array<string>")
    got = {x.seq: x.is_correct for x in runs.judge_answers(log, orders, implicit_start_ms=0, resets=False).collect()}
    assert {s: got[s] for s in want} == want and len(got) == 9000
